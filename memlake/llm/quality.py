"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a built-in expression over one row, so judging a table is a
scan: no shuffle, no user function, no state, and a long text costs its own
task only its own length.

Repeated 8-word windows are found in two steps.  Windows are hashed; a text
whose hashes all differ has no repeated window.  In the others the windows
themselves are sorted with their positions and neighbours compared, so the
count is exact and takes n log n for n words.

Defined cases: null text has no words, lines or symbols and fails the base
rule; extra columns are ignored; repeated rows are judged alike; an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = """
the be to of and that have with for in is on by this was are as at it not from or an
le la les de des du un une et en que qui pour dans sur par au aux avec est ce
der die das und zu in den von mit dem des im für auf ist ein eine sich nicht
el la los las de del y en que un una por con para es se al lo su no
""".split()


@dataclass(frozen=True)
class Rule:
    """A text passes if low <= measure <= high; a bound of None is open."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("too_few_words", "n_words", low=MIN_WORDS),
    Rule("repeated_windows", "repeat_percent", high=MAX_REPEAT_PERCENT),
    Rule("word_length", "mean_word_length", low=2.0, high=14.0),
    Rule("symbols", "symbols_per_word", high=0.1),
    Rule("marks", "marks_per_word", high=0.25),
    Rule("duplicate_lines", "dup_line_share", high=0.4),
    Rule("bullet_lines", "bullet_line_share", high=0.9),
    Rule("ellipsis_lines", "ellipsis_line_share", high=0.3),
    Rule("upper_case", "upper_share", high=0.5),
    Rule("stuttering", "stutter_share", high=0.3),
    Rule("stop_words", "stop_word_share", low=0.02),
)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, also inside interpreted lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _windows(words: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.array_join(F.slice(words, i + 1, size), " "))


def _repeated_words(words: Column, size: int) -> Column:
    """Words inside windows of that size found twice or more."""

    def covered(at: Column) -> Column:
        # ascending window starts: each adds what the one before left uncovered
        step = F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda a, b: F.least(b - a, F.lit(size)))
        return F.when(F.size(at) == 0, F.lit(0)).otherwise(F.aggregate(step, F.lit(size), lambda s, x: s + x))

    def starts(windows: Column) -> Column:
        rows = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        none = F.array(F.lit(None).cast("struct<w:string,i:int>"))

        def flagged(r: Column) -> Column:
            same_before = F.zip_with(r, F.concat(none, F.slice(r, 1, F.size(r) - 1)), lambda a, b: F.struct(a["i"].alias("i"), a["w"].eqNullSafe(b["w"]).alias("d")))
            same_after = F.zip_with(same_before, F.concat(F.slice(r, 2, F.size(r) - 1), none), lambda a, b: F.struct(a["i"].alias("i"), a["d"].alias("d"), b["w"].alias("n")))
            own = F.zip_with(same_after, r, lambda a, b: F.struct(a["i"].alias("i"), (a["d"] | a["n"].eqNullSafe(b["w"])).alias("d")))
            return F.sort_array(F.transform(F.filter(own, lambda x: x["d"]), lambda x: x["i"]))

        return _let(rows, flagged)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    window_hashes = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(F.slice(h, i + 1, size)))
    some_twice = _let(_let(hashes, window_hashes), lambda h: F.size(F.array_distinct(h)) < F.size(h))
    exact = _let(_let(_windows(words, size), starts), covered)
    return F.when(F.size(words) <= size, F.lit(0)).otherwise(F.when(some_twice, exact).otherwise(F.lit(0)))


def measures(docs: DataFrame, *keep: str | Column, text: str = "text") -> DataFrame:
    """keep and all measures of each row."""
    t = F.coalesce(F.col(text), F.lit(""))
    blank = "\t\n\x0b\x0c\r"
    df = docs.select(*keep, t.alias("_t"))
    held = df.columns[:-1]
    df = df.select("*", F.filter(F.split(F.translate("_t", blank, " " * 5), " +"), lambda w: w != "").alias("_w"),
                   F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, " " + blank, "")) > 0).alias("_l"),
                   F.length(F.translate("_t", " " + blank, "")).cast("long").alias("word_chars"))
    size, lines = F.size("_w"), F.size("_l")
    df = df.select(
        "*",
        size.cast("long").alias("n_words"),
        (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.length("_t") - F.length(F.translate("_t", "!?", ""))).cast("long").alias("n_marks"),
        (lines - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("_w"), WINDOW).cast("long").alias("n_repeat_words"),
        lines.cast("long").alias("n_lines"),
        F.size(F.filter("_l", lambda x: F.ltrim(x).rlike(r"^[-*•·] "))).alias("_bullets"),
        F.size(F.filter("_l", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).alias("_dots"),
        (F.length("_t") - F.length(F.translate("_t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("_upper"),
        F.size(F.filter(F.zip_with(F.slice("_w", 1, F.greatest(size - 1, F.lit(0))), F.slice("_w", 2, F.greatest(size - 1, F.lit(0))), lambda a, b: a == b), lambda x: x)).alias("_stutters"),
        F.size(F.filter(F.transform("_w", F.lower), lambda w: w.isin(STOP_WORDS))).alias("_stops"),
    )
    per_word = lambda c: F.when(F.col("n_words") > 0, F.col(c) / F.col("n_words")).otherwise(F.lit(0.0))
    per_line = lambda c: F.when(F.col("n_lines") > 0, F.col(c) / F.col("n_lines")).otherwise(F.lit(0.0))
    return df.select(
        *held,
        *[c for c in df.columns[len(held) :] if not c.startswith("_")],
        per_word("word_chars").alias("mean_word_length"),
        per_word("n_symbols").alias("symbols_per_word"),
        per_word("n_marks").alias("marks_per_word"),
        (100 * per_word("n_repeat_words")).alias("repeat_percent"),
        per_line("n_dup_lines").alias("dup_line_share"),
        per_line("_bullets").alias("bullet_line_share"),
        per_line("_dots").alias("ellipsis_line_share"),
        F.when(F.col("word_chars") > 0, F.col("_upper") / F.col("word_chars")).otherwise(F.lit(0.0)).alias("upper_share"),
        per_word("_stutters").alias("stutter_share"),
        per_word("_stops").alias("stop_word_share"),
    )


def judge(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """measured with base_failed, failed_rules (names, in the table's order) and kept."""
    tests = []
    for r in rules:
        m = F.col(r.measure)
        bad = (m < r.low if r.low is not None else F.lit(False)) | (m > r.high if r.high is not None else F.lit(False))
        tests.append(F.when(bad, F.lit(r.name)))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = measured.select("*", base.alias("base_failed"), F.array_compact(F.array(*tests)).alias("failed_rules"))
    return out.select("*", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"))


def passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows of docs that are kept.

    The projection carries a row number that the filter reads, so that the
    optimizer does not push the filter, with all measures written out again,
    below the projection.
    """
    names = docs.columns
    judged = judge(measures(docs, F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")), rules)
    fixed = judged.select("row", "kept", F.monotonically_increasing_id().alias("_r"))
    return fixed.filter("kept and _r >= 0").select(*[F.col("row")[c].alias(c) for c in names])
