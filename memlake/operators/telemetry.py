"""Rollups of recall logs, and reducers that merge states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def access_rollup(log: DataFrame) -> DataFrame:
    return log.groupBy("hash").agg(F.count("*").alias("recall_count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def query_rollup(log: DataFrame) -> DataFrame:
    return log.groupBy("qkey").agg(F.count("*").alias("run_count"), F.count_if(F.col("n_results") == 0).alias("empty_count"), F.sum("n_results").alias("sum_results"), F.max("ts").alias("last_ts"))


def budget_rollup(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("sample_count"), F.count_if("overflow").alias("overflow_count"))


def reduce_states(writes: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(key, field, value) from (key, field, value, ord): lww, append, sum, max or min by field; not a number: last write."""
    n = F.col("value").try_cast("double")
    numeric = F.count_if(n.isNull() & F.col("value").isNotNull()) == 0
    last = F.max_by("value", "ord")

    def text(x: Column) -> Column:
        return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))

    aggs = {
        "lww": last,
        "append": F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]), ","),
        "sum": F.when(numeric, text(F.sum(n))).otherwise(last),
        "max": F.when(numeric, text(F.max(n))).otherwise(last),
        "min": F.when(numeric, text(F.min(n))).otherwise(last),
    }
    by = writes.groupBy("key", "field").agg(*[a.alias(k) for k, a in aggs.items() if k in {"lww", *rules.values()}])
    value = F.col("lww")
    for f, rule in rules.items():
        value = F.when(F.col("field") == f, F.col(rule)).otherwise(value)
    return by.select("key", "field", value.alias("value"))


def store_stats(grains: DataFrame) -> DataFrame:
    return grains.agg(
        F.count("*").alias("grains"), F.count_if(F.col("superseded_by").isNull()).alias("live"), F.countDistinct("ns").alias("namespaces"),
        F.countDistinct("session_id").alias("sessions"), F.countDistinct("run_id").alias("runs"), F.countDistinct("grain_type").alias("types"))


def accumulate(tips: DataFrame, deltas: DataFrame) -> DataFrame:
    """(key, field, value): the tip's number plus all deltas, or the last value that was set and the deltas after it.

    deltas: key, field, op (add or set), amount, ord.
    """
    last_set = deltas.filter("op = 'set'").groupBy("key", "field").agg(F.max_by("amount", "ord").alias("base_set"), F.max("ord").alias("set_at"))
    adds = deltas.filter("op = 'add'").join(last_set, ["key", "field"], "left").filter(F.col("set_at").isNull() | (F.col("ord") > F.col("set_at")))
    total = adds.groupBy("key", "field").agg(F.sum("amount").alias("added"))
    base = tips.join(last_set, ["key", "field"], "full").join(total, ["key", "field"], "full")
    return base.select("key", "field", (F.coalesce("base_set", "amount", F.lit(0.0)) + F.coalesce("added", F.lit(0.0))).alias("value"))
