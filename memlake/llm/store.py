"""Helpers of the operators on DataFrames; shared tables come from the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..shared import cut, drop, shared_dir


def width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """names, and all other columns as one struct, _rest, so that their names can clash with nothing."""
    rest = [c for c in docs.columns if c not in names]
    return docs.select(*names, (F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(0)).alias("_rest"))


def unpacked(docs: DataFrame, names: list[str]) -> list[Column]:
    """The columns names of packed rows, in that order."""
    return [F.col(c) if c in docs.columns and c != "_rest" else F.col("_rest")[c].alias(c) for c in names]


def free_name(taken: list[str], name: str) -> str:
    """name, with underscores before it until no column of taken (whatever its case) is called so."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = "_" + name
    return name


__all__ = ["cut", "drop", "free_name", "packed", "shared_dir", "unpacked", "width"]
