"""Connected components of an edge table by alternating large and small stars.

Every round is two joins with per-vertex minima; the minima are partial sums,
written out first so that the join's shuffle of a hub's edges can be split.
Rounds end when no edge changes; their number grows with the logarithm of the
longest chain.  The driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import cut, drop


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of edges (a, b): the smallest vertex it is connected with."""
    spark = edges.sparkSession
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, path = cut(e)
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low, p1 = cut(both.groupBy(F.col("u").alias("k")).agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = both.join(low, F.col("u") == F.col("k")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, p2 = cut(large)
        low, p3 = cut(large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")))
        small = large.join(low, F.col("u") == F.col("k")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()
        new, new_path = cut(small)
        now = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        drop(spark, path, p1, p2, p3)
        e, path = new, new_path
        if now == before:
            roots = e.select(F.col("v").alias("u"), "v").distinct()
            return e.unionByName(roots).select(F.col("u").alias("v"), F.col("v").alias("root"))
        before = now
