"""Budgeted assembly of several sources into one context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from ..functions.text import estimate_tokens
from ..plans.lexer import QueryError

DEFAULT_BUDGET, CAP = 4000, 2000
# Shares by number of sources where no weight is given.
DEFAULT_SHARES = {1: [1.0], 2: [0.65, 0.35], 3: [0.5, 0.3, 0.2], 4: [0.40, 0.28, 0.20, 0.12]}
TOKEN_FIELDS = ("subject", "relation", "object", "content", "confidence", "created_at", "session_id", "role")


def tokens_of(df: DataFrame) -> Column:
    return estimate_tokens({f: F.col(f) for f in TOKEN_FIELDS if f in df.columns})


def shares(labels: list[str], weights: dict[str, float]) -> dict[str, float]:
    """Normalised weights, unlisted labels 0; without any, the default shares."""
    given = {x: max(0.0, weights.get(x, 0.0)) for x in labels}
    total = sum(given.values())
    if total > 0:
        return {x: w / total for x, w in given.items()}
    plain = DEFAULT_SHARES.get(len(labels)) or [0.6**i for i in range(len(labels))]
    return {x: w / sum(plain) for x, w in zip(labels, plain, strict=True)}


def allocate(labels: list[str], weights: dict[str, float], budget: int, pinned: dict[str, int]) -> dict[str, int]:
    """Tokens for each label: pins at their cost, the rest shared."""
    left = budget - sum(pinned.values())
    if left < 0:
        raise QueryError("CAL-E122", f"pinned sources need {sum(pinned.values())} of {budget} tokens")
    free = [x for x in labels if x not in pinned]
    share = shares(free, weights) if free else {}
    return {x: pinned.get(x, int(left * share.get(x, 0.0) + 0.5)) for x in labels}


def dedup_sources(rows: DataFrame, name: str | None, order: list[str]) -> DataFrame:
    """By hash the first in source order (literals exempt), or by field the copy of the source first in order."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("source"))
    if name is None:
        w = W.partitionBy("hash").orderBy("_source_no", "_rank")
        exempt = F.col("hash").isNull() | (F.col("hash") == "")
    else:
        w = W.partitionBy(F.coalesce(F.col(name).cast("string"), F.lit(""))).orderBy(place, "_rank")
        exempt = F.lit(False)
    return rows.withColumn("_n", F.row_number().over(w)).filter(exempt | (F.col("_n") == 1)).drop("_n")


def cap(rows: DataFrame, most: int = CAP) -> DataFrame:
    """At most so many rows over all sources, in proportion, one of each at least."""
    n = F.row_number().over(W.partitionBy("source").orderBy("_rank"))
    per = rows.groupBy("source").agg(F.count("*").alias("_per"))
    rows = rows.withColumn("_n", n).join(per, "source").join(F.broadcast(rows.agg(F.count("*").alias("_all"))))  # one row
    return rows.filter((F.col("_all") <= most) | (F.col("_n") <= F.greatest(F.lit(1), F.ceil(F.col("_per") / F.col("_all") * most)))).drop("_per", "_all", "_n")


def budget_prefix(rows: DataFrame, allocation: dict[str, int], pinned: set[str] = frozenset()) -> DataFrame:
    """Rows of each source while their running sum of tokens stays within its allocation; the first always."""
    w = W.partitionBy("source").orderBy("_rank")
    rows = rows.withColumns({"running": F.sum("tokens").over(w.rowsBetween(W.unboundedPreceding, 0)), "_n": F.row_number().over(w)})
    alloc = F.create_map(*[x for k, v in allocation.items() for x in (F.lit(k), F.lit(v))])
    return rows.filter((F.col("running") <= F.element_at(alloc, F.col("source"))) | (F.col("_n") == 1) | F.col("source").isin(list(pinned))).drop("_n")


def disclosure(rows: DataFrame, budget: int, full: float = 0.7, summary: float = 0.95) -> DataFrame:
    """Greedy by score: full while within 70% of the budget, else a summary while within 95%, else left out.

    From (item, score, full_tokens, summary_tokens).  A fold over the pool's
    rows in order: an assembled pool has CAP rows at most.
    """
    pool = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "item", F.col("full_tokens").alias("f"), F.col("summary_tokens").alias("s"))))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<struct<item:bigint,level:string,used:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        as_full, as_summary = acc["used"] + x["f"] <= full * budget, acc["used"] + x["s"] <= summary * budget
        used = (acc["used"] + F.when(as_full, x["f"]).when(as_summary, x["s"]).otherwise(F.lit(0))).cast("bigint")
        level = F.when(as_full, F.lit("full")).when(as_summary, F.lit("summary")).otherwise(F.lit("omit"))
        return F.struct(used.alias("used"), F.concat(acc["out"], F.array(F.struct(x["item"].cast("bigint").alias("item"), level.alias("level"), used.alias("used")))).alias("out"))

    folded = rows.agg(F.aggregate(pool, start, step, lambda a: a["out"]).alias("o"))
    return folded.select(F.explode("o").alias("x")).select("x.*")


def type_floor(rows: DataFrame, per_type: int, budget: int) -> DataFrame:
    """First the best per_type of each type, then the rest by score, while their tokens fit.

    A row has one token at least, so only the first budget rows can fit: the
    running sum is over a top-k, never over all rows in one task.
    """
    w = W.partitionBy("grain_type").orderBy(F.desc("score"), "item")
    rows = rows.withColumn("_floor", (F.row_number().over(w) > per_type).cast("int"))
    rows = rows.orderBy("_floor", F.desc("score"), "item").limit(budget)
    run = F.sum("tokens").over(W.orderBy("_floor", F.desc("score"), "item").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("running", run).filter(F.col("running") <= budget).drop("_floor")


def timeline(rows: DataFrame) -> DataFrame:
    """Chronological, with the time since the row before as text."""
    gap = (F.col("created_at") - F.lag("created_at").over(W.orderBy("created_at", "seq"))) / 86_400_000
    days = F.floor(gap)
    plural = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))
    label = F.when(days >= 365, plural(F.floor(days / 365), "year")).when(days >= 30, plural(F.floor(days / 30), "month")).when(days >= 1, plural(days, "day"))
    return rows.withColumn("since_last", label)


def stale_pairs(rows: DataFrame) -> DataFrame:
    """Without superseded rows whose superseder is there too."""
    there = rows.select(F.col("hash").alias("superseded_by"))
    return rows.join(there, "superseded_by", "left_anti").unionByName(rows.limit(0))


def relative_order(rows: DataFrame, how: str) -> DataFrame:
    keys = {"chronological": [F.asc("created_at"), F.asc("seq")], "reverse": [F.desc("created_at"), F.desc("seq")], "entity": [F.asc("subject"), F.desc("score"), F.asc("seq")], "relevance": [F.desc("score"), F.asc("seq")]}
    return rows.orderBy(*keys[how])
