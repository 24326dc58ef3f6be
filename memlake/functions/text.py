"""Text functions as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MAX_TOKEN = 64


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits of 64 characters at most."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: (t != "") & (F.length(t) <= MAX_TOKEN))


def projection(subject: Column, relation: Column, object_: Column, content: Column) -> Column:
    """The text that is searched: "s r o" if all three are there, then the content."""
    triple = F.when(subject.isNotNull() & relation.isNotNull() & object_.isNotNull(), F.concat_ws(" ", subject, relation, object_))
    return F.concat_ws(" ", triple, content)


def normalize_ident(c: Column) -> Column:
    return F.lower(F.trim(c))


def normalize_signature(c: Column) -> Column:
    """First 80 characters, lower case, paths and digit runs masked, single spaces."""
    head = F.substring(F.lower(F.trim(c)), 1, 80)
    words = F.filter(F.split(head, r"\s+"), lambda w: w != "")
    masked = F.transform(words, lambda w: F.when(w.contains("/") | w.contains("\\"), F.lit("<path>")).otherwise(F.regexp_replace(w, r"[0-9]+", "#")))
    return F.array_join(masked, " ")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty sets are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def word_bigrams(text: Column) -> Column:
    return _pairs(tokens(text))


def _pairs(words: Column) -> Column:
    n = F.size(words)
    pair = F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda x, y: F.concat_ws(" ", x, y))
    return F.array_distinct(pair)


def truncate(c: Column, n: int) -> Column:
    """The first n characters, and "..." if there were more."""
    if not 1 <= n <= 100_000:
        raise ValueError("truncate takes 1 to 100000 characters")
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def humanize_relation(c: Column) -> Column:
    return F.replace(F.regexp_replace(c, r"^[^:]*:", ""), F.lit("_"), F.lit(" "))


def percent(c: Column) -> Column:
    return F.concat((c * 100).cast("long").cast("string"), F.lit("%"))


def format_date(seconds: Column, pattern: str) -> Column:
    """UTC date by %Y %m %d %H %M %S."""
    out = pattern
    for code, letters in {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss"}.items():
        out = out.replace(code, letters)
    return F.date_format(F.timestamp_seconds(seconds), out)


def relative(then_s: Column, now_s: Column) -> Column:
    """just now, 5m ago, 3h ago, 2d ago, ~3w ago, or the date; for 0 unknown."""
    age = now_s - then_s
    ago = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(unit + " ago"))
    return (
        F.when(then_s == 0, F.lit("unknown")).when(age < 0, F.lit("in the future")).when(age < 60, F.lit("just now"))
        .when(age < 3600, ago(age / 60, "m")).when(age < 86400, ago(age / 3600, "h")).when(age < 7 * 86400, ago(age / 86400, "d"))
        .when(age < 30 * 86400, F.concat(F.lit("~"), ago(age / (7 * 86400), "w"))).otherwise(F.date_format(F.timestamp_seconds(then_s), "yyyy-MM-dd"))
    )


def relative_label(then_ms: Column, now_ms: Column) -> Column:
    """3 hours ago, with the largest unit that is there, up to years."""
    s = F.floor((now_ms - then_ms) / 1000)
    label = F.lit("just now")
    for unit, size in (("minute", 60), ("hour", 3600), ("day", 86400), ("week", 604800), ("month", 2592000), ("year", 31536000)):
        n = F.floor(s / size)
        label = F.when(s >= size, F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")), F.lit(" ago"))).otherwise(label)
    return label


def estimate_tokens(fields: dict[str, Column]) -> Column:
    """A quarter of the bytes of all keys and values with 4 for each pair, 1 at least; absent fields count nothing."""
    total = F.lit(0)
    for name, c in fields.items():
        size = F.octet_length(c.cast("string")) + len(name.encode()) + 4
        total = total + F.coalesce(size, F.lit(0))
    return F.greatest(F.floor(total / 4), F.lit(1)).cast("long")


def disclosure_tier(budget: Column, n: Column) -> Column:
    per = budget / F.when(n > 0, n)
    return F.when(per >= 200, F.lit("full")).when(per >= 80, F.lit("headlines")).otherwise(F.lit("summary"))


def iso_to_ms(c: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(c))


def hmac_sha256(c: Column, key: bytes) -> Column:
    """HMAC-SHA-256 of a text as hex, from two built-in digests."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ x for b in key)) for x in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(c, "utf-8")), 256))
    return F.sha2(F.concat(outer, first), 256)
