"""Pipeline stages.  Order is explicit: _rank is a row's place among the rows that a statement returned."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from ..plans.ast import Stage
from ..schema import NUMERIC
from .predicates import field

ENVELOPE = ("hash", "grain_type", "score")


def apply(df: DataFrame, stages: list[Stage], bound: int) -> DataFrame:
    """bound: rows that the statement returns at most; a sort is a top-k of so many."""
    for s in stages:
        df = _Stages.order(df, *s.args, bound) if s.name == "order" else getattr(_Stages, s.name)(df, *s.args)
    return df


def _col(df: DataFrame, name: str):
    low = {"namespace": "ns", "type": "grain_type"}.get(name, name)
    return F.col(low) if low in df.columns else field(low) if "attrs" in df.columns else F.lit(None).cast("string")


def _kept(df: DataFrame) -> list[str]:
    return [c for c in (*ENVELOPE, "_rank") if c in df.columns]


class _Stages:
    @staticmethod
    def select(df: DataFrame, *names: str) -> DataFrame:
        return df.select(*_kept(df), *[_col(df, n).alias(n) for n in names if n not in ENVELOPE])

    @staticmethod
    def project(df: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
        return df.select(*_kept(df), *[_col(df, a).alias(b) for a, b in pairs])

    @staticmethod
    def order(df: DataFrame, name: str, down: bool, bound: int) -> DataFrame:
        """Absent values are the smallest; equal ones stay in their order."""
        key = _col(df, name)
        key = key.try_cast("double") if name in NUMERIC else key
        top = df.withColumn("_key", key).orderBy(F.col("_key").desc_nulls_last() if down else F.col("_key").asc_nulls_first(), "_rank").limit(bound)
        w = W.orderBy(F.col("_key").desc_nulls_last() if down else F.col("_key").asc_nulls_first(), "_rank")
        return top.withColumn("_rank", F.row_number().over(w).cast("long")).drop("_key")

    @staticmethod
    def limit(df: DataFrame, n: int) -> DataFrame:
        return df.orderBy("_rank").limit(n)

    @staticmethod
    def offset(df: DataFrame, n: int) -> DataFrame:
        return df.orderBy("_rank").offset(n)

    @staticmethod
    def first(df: DataFrame) -> DataFrame:
        return df.orderBy("_rank").limit(1)

    @staticmethod
    def count(df: DataFrame) -> DataFrame:
        return df.agg(F.count("*").alias("count"))

    @staticmethod
    def _extract(df: DataFrame, name: str) -> DataFrame:
        return df.filter(F.col(name).isNotNull()).select("_rank", F.col(name).alias("value"))

    @staticmethod
    def subjects(df: DataFrame) -> DataFrame:
        return _Stages._extract(df, "subject")

    @staticmethod
    def objects(df: DataFrame) -> DataFrame:
        return _Stages._extract(df, "object")

    @staticmethod
    def hashes(df: DataFrame) -> DataFrame:
        return _Stages._extract(df, "hash")

    @staticmethod
    def group(df: DataFrame, name: str) -> DataFrame:
        """Regrouped, not aggregated: keys in order, absent last, rows of a key in their order."""
        key = _col(df, name).cast("string")
        df = df.withColumn("group_key", key)
        return df.withColumn("_rank", F.row_number().over(W.orderBy(F.col("group_key").asc_nulls_last(), "_rank")).cast("long"))


def aggregate_by(df: DataFrame, name: str) -> DataFrame:
    """The true aggregate that GROUP BY is not: rows and time range by key."""
    return df.groupBy(_col(df, name).alias(name)).agg(F.count("*").alias("n"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))
