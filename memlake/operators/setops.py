"""Set operations by content address, keeping the left side's order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left rows, then right rows whose hash is not among them."""
    both = left.withColumn("_side", F.lit(0)).unionByName(right.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    w = W.partitionBy("hash").orderBy("_side", "_rank")
    once = both.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    # right ranks follow all left ranks
    return once.withColumn("_rank", F.col("_rank") + F.col("_side").cast("long") * (1 << 40)).drop("_n", "_side")


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right.select("hash").distinct(), "hash", "left_semi")


def except_(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right.select("hash").distinct(), "hash", "left_anti")


def combine(op: str, operands: list[DataFrame]) -> DataFrame:
    return reduce({"union": union, "intersect": intersect, "except": except_}[op], operands)


def coalesce(branches: list[DataFrame]) -> DataFrame:
    """The first branch that has rows, decided in one plan: nothing is run to find out."""
    tagged = [b.withColumn("_branch", F.lit(i)) for i, b in enumerate(branches)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    first = both.agg(F.min("_branch").alias("_first"))
    return both.join(F.broadcast(first), F.col("_branch") == F.col("_first")).drop("_branch", "_first")
