"""Mixing sources to target weights by hash-threshold histograms.

Each document has a fixed hash, each source a target of words.  A histogram of
words by source and leading hash bits gives nested thresholds: every bucket
below the boundary bucket is taken whole, only the boundary bucket is refined
by the next bits, and so on.  The mix is then one filter on hash < threshold;
nothing is sorted and no document list is gathered anywhere.

Shuffled are partial sums (source, bucket) only.  A hot source is summed where
its rows lie; its share of the shuffle is as small as any other's.

A document's place is a hash of its doc_id and text, then of its row's number,
so that rows of one doc_id and text, however many, can be cut apart too; among
such equal rows alone the choice depends on how the table is split for reading.

Defined cases: null text has size 0; a null source is a source of its own and
comes last; null and repeated doc_ids and equal rows are taken row by row; an
empty table gives an empty result; other columns are ignored, and where one is
called copy, the copy's number is called _copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from .store import cut, free_name, packed, unpacked

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
LEVELS = 6
TIE_BITS = 20
BITS = 10
SEED = 7
SPACE = r"[\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in text, null: 0."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(plain, " +"), lambda w: w != "")).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """sources with their 0-based rank by code point, nulls last, without one task for all of them."""
    parts = sources.sort(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id())
    parts, _ = cut(parts)
    before = {r["_part"]: r["n"] for r in parts.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    total, pairs = 0, []
    for p in sorted(before):
        pairs += [F.lit(p), F.lit(total)]
        total += before[p]
    inside = W.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())
    start = F.element_at(F.create_map(*pairs), F.col("_part")) if pairs else F.lit(0)
    return parts.withColumn("_rank", F.row_number().over(inside) - 1 + start).drop("_part")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size).

    The targets are min(most * source_size, level * weight) with the level at
    which they add up to share * all sizes: what resharing each excess by
    weight, again and again, ends at.  Each round of it is one aggregate over
    the source table; the driver sees three numbers.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = _ranked(cut(per)[0])
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", w).withColumn("cap", most * F.col("source_size"))
    ranked, _ = cut(ranked.drop("_rank"))
    total = share * float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:
        full = F.col("cap") <= level * F.col("weight")
        r = ranked.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("cap"))).alias("capped"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if r["n"] == stopped or not r["open"]:
            level = level if r["open"] else float("inf")
            break
        stopped, level = r["n"], max(level, (total - (r["capped"] or 0.0)) / r["open"])
    target = F.col("cap") if level == float("inf") else F.least("cap", F.lit(level) * F.col("weight"))
    return ranked.select("source", "source_size", target.alias("target"))


def thresholds(slim: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target, whole, threshold) from (source, size, _h).

    A document is taken whole times, and once more if _h < threshold.
    """
    state = targets(slim.select("source", "size"), weights, share, most)
    whole = F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")))
    state = state.withColumn("whole", F.coalesce(whole, F.lit(0)).cast("long"))
    state = state.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    state = state.withColumn("prefix", F.lit(0).cast("long"))
    for level in range(LEVELS):
        left = BITS * (LEVELS - 1 - level)
        s = state.select(F.col("source").alias("_s"), F.col("prefix").alias("_p"))
        inside = slim if level == 0 else slim.join(s, slim["source"].eqNullSafe(s["_s"]) & (F.shiftright("_h", left + BITS) == F.col("_p"))).select("source", "size", "_h")
        hist = inside.groupBy("source", F.shiftright("_h", left).alias("bucket")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(W.partitionBy("source").orderBy("bucket"))
        hist = hist.withColumn("_upto", upto).withColumnsRenamed({"source": "_s"})
        # the boundary bucket: the first whose running sum passes the rest of the target
        at = state.join(hist, state["source"].eqNullSafe(hist["_s"]), "left")
        over = F.col("_upto") > F.col("rest")
        lowest = F.min(F.when(over, F.struct("bucket", (F.col("_upto") - F.col("words")).alias("before"), "_upto"))).alias("_b")
        top = F.max("_upto").alias("_all")
        state = at.groupBy("source", "source_size", "target", "whole", "rest", "prefix").agg(lowest, top)
        # without one, all of the bucket refined so far is taken
        end = F.shiftleft(F.col("prefix") + 1, BITS)
        # at the last level the boundary bucket, a document as a rule, is taken if that comes nearer
        near = (F.col("_b._upto") - F.col("rest") < F.col("rest") - F.col("_b.before")) if not left else F.lit(False)
        state = state.select(
            "source", "source_size", "target", "whole",
            (F.col("rest") - F.when(F.col("_b").isNull(), F.coalesce("_all", F.lit(0))).otherwise(F.col("_b.before"))).alias("rest"),
            F.coalesce(F.col("_b.bucket") + near.cast("long"), end).alias("prefix"),
        )
        state, _ = cut(state)
    return state.select("source", "source_size", "target", "whole", F.col("prefix").alias("threshold"))


def position(key: Column, text: Column, row: Column, seed: int = SEED) -> Column:
    """A document's fixed place among 2 ** (BITS * LEVELS): of its key and text, the last TIE_BITS of its row's number."""
    own = F.shiftrightunsigned(F.xxhash64(key, text, F.lit(seed)), 64 - BITS * LEVELS + TIE_BITS)
    tie = F.shiftrightunsigned(F.xxhash64(row, F.lit(seed)), 64 - TIE_BITS)
    return F.shiftleft(own, TIE_BITS).bitwiseOR(tie)


def taken(rows: DataFrame, limits: DataFrame, most: float = MOST) -> DataFrame:
    """rows (with source, size and _h) with their source's size and target, and copies: one join and one comparison."""
    t = limits.withColumnRenamed("source", "_s")
    out = rows.join(t, rows["source"].eqNullSafe(t["_s"]), "left").drop("_s")
    copies = F.least(F.col("whole") + (F.col("_h") < F.col("threshold")).cast("long"), F.lit(int(most)).cast("long"))
    return out.withColumn("copies", copies).drop("whole", "threshold", "_h")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of docs."""
    slim, _ = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), position(F.col("doc_id"), F.col("text"), F.monotonically_increasing_id()).alias("_h")))
    out = taken(slim, thresholds(slim, weights, share, most), most)
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with copy numbered from 1."""
    rows = packed(docs, "doc_id", "text", "source")
    sized = rows.select("*", n_words(F.col("text")).alias("size"), position(F.col("doc_id"), F.col("text"), F.monotonically_increasing_id()).alias("_h"))
    slim, _ = cut(sized.select("source", "size", "_h"))
    out = taken(sized, thresholds(slim, weights, share, most), most).filter("copies > 0")
    return out.select(*unpacked(rows, docs.columns), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(free_name(docs.columns, "copy")))
