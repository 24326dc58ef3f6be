"""Other systems' exports as grains, read as JSON or text and projected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import iso_to_ms
from .tables import canonical


def _number(df: DataFrame) -> DataFrame:
    """seq from the input's order: file name, then place in it."""
    return df.withColumn("seq", F.monotonically_increasing_id())


def _has(df: DataFrame, *names: str):
    have = [n for n in names if n in df.columns]
    return F.coalesce(*[F.col(n).cast("string") for n in have]) if have else F.lit(None).cast("string")


def _time(df: DataFrame, *names: str):
    c = _has(df, *names)
    return F.coalesce(c.try_cast("bigint"), iso_to_ms(c), F.lit(0).cast("bigint"))


def mem0(spark: SparkSession, path: str, ns: str = "shared") -> DataFrame:
    """{"results": [{id, memory, user_id, created_at}]} or one such object a line."""
    df = spark.read.option("multiLine", True).json(path)
    if "results" in df.columns:
        df = df.select(F.explode("results").alias("r")).select("r.*")
    df = _number(df)
    return canonical(df.select("seq", F.lit(ns).alias("ns"), F.lit("fact").alias("grain_type"), _has(df, "user_id").alias("subject"), F.lit("remembers").alias("relation"),
                               _has(df, "memory", "text").alias("object"), _has(df, "user_id").alias("user_id"), _time(df, "updated_at", "created_at").alias("created_at")))


def mem0_history(spark: SparkSession, path: str, ns: str = "shared") -> DataFrame:
    """One {memory_id, old_memory, new_memory, event, created_at} a line: versions of one key by memory_id."""
    df = _number(spark.read.json(path))
    df = df.filter(F.col("event") != "DELETE")
    return canonical(df.select("seq", F.lit(ns).alias("ns"), F.lit("fact").alias("grain_type"), _has(df, "memory_id").alias("subject"), F.lit("remembers").alias("relation"),
                               _has(df, "new_memory").alias("object"), _time(df, "created_at").alias("created_at")))


def messages(spark: SparkSession, path: str, ns: str = "shared") -> DataFrame:
    """Chat JSON lines: session or thread_id, role, content, created_at or ts."""
    df = _number(spark.read.json(path))
    return canonical(df.select("seq", F.lit(ns).alias("ns"), F.lit("event").alias("grain_type"), _has(df, "session_id", "thread_id", "session").alias("session_id"), _has(df, "role", "type").alias("role"),
                               _has(df, "content", "text", "value").alias("content"), _time(df, "created_at", "timestamp", "ts").alias("created_at")))


langgraph = letta = messages


def letta_archival(spark: SparkSession, path: str, ns: str = "shared") -> DataFrame:
    df = _number(spark.read.json(path))
    return canonical(df.select("seq", F.lit(ns).alias("ns"), F.lit("observation").alias("grain_type"), _has(df, "text", "content").alias("content"), _time(df, "created_at").alias("created_at")))


def zep(spark: SparkSession, path: str, ns: str = "shared") -> DataFrame:
    """Graph edges: source, name, target, valid_at, invalid_at, fact."""
    df = _number(spark.read.json(path))
    return canonical(df.select("seq", F.lit(ns).alias("ns"), F.lit("fact").alias("grain_type"), _has(df, "source", "source_node").alias("subject"), F.lower(_has(df, "name", "relation")).alias("relation"),
                               _has(df, "target", "target_node").alias("object"), _has(df, "fact").alias("content"), _time(df, "created_at", "valid_at").alias("created_at"),
                               iso_to_ms(_has(df, "valid_at")).alias("valid_from"), iso_to_ms(_has(df, "invalid_at")).alias("valid_to")))


def jsonl(spark: SparkSession, path: str, ns: str = "shared") -> DataFrame:
    """One grain a line, its columns by name."""
    df = spark.read.json(path)
    df = df if "seq" in df.columns else _number(df)
    for c, default in (("ns", ns), ("grain_type", "fact")):
        df = df if c in df.columns else df.withColumn(c, F.lit(default))
    df = df if "created_at" in df.columns else df.withColumn("created_at", F.lit(0))
    return canonical(df)


def markdown_notes(spark: SparkSession, path: str, ns: str = "notes") -> DataFrame:
    """Notes with lines such as "- [category] text" and "- relation [[target]]"; the file is the subject."""
    lines = _number(spark.read.text(path).withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.md)?$", 1)))
    link = F.regexp_extract("value", r"^- (\w+) \[\[(.+?)\]\]", 0) != ""
    note = F.regexp_extract("value", r"^- \[(\w+)\] (.+)$", 0) != ""
    hit = lines.filter(link | note)
    rel = F.when(link, F.regexp_extract("value", r"^- (\w+) \[\[", 1)).otherwise(F.regexp_extract("value", r"^- \[(\w+)\]", 1))
    obj = F.when(link, F.regexp_extract("value", r"\[\[(.+?)\]\]", 1)).otherwise(F.regexp_extract("value", r"^- \[\w+\] (.+)$", 1))
    return canonical(hit.select("seq", F.lit(ns).alias("ns"), F.lit("fact").alias("grain_type"), F.col("file").alias("subject"), rel.alias("relation"), obj.alias("object"), F.lit(0).alias("created_at")))


def tool_log(spark: SparkSession, path: str, ns: str = "tools") -> DataFrame:
    """One {tool, ok, error, duration_ms, ts, run_id} a line; each call is its own grain."""
    df = _number(spark.read.json(path))
    failed = F.coalesce(~F.col("ok"), F.lit(False)) if "ok" in df.columns else _has(df, "error").isNotNull()
    attrs = F.create_map(F.lit("tool_name"), _has(df, "tool", "tool_name"), F.lit("is_error"), failed.cast("string"), F.lit("duration_ms"), _has(df, "duration_ms"))
    return canonical(df.select("seq", F.lit(ns).alias("ns"), F.lit("tool").alias("grain_type"), _has(df, "error", "output").alias("content"), _has(df, "run_id").alias("run_id"),
                               _time(df, "ts", "created_at").alias("created_at"), attrs.alias("attrs")))


READERS = {
    "mem0": mem0, "mem0-history": mem0_history, "langgraph": langgraph, "letta": letta, "letta-archival": letta_archival, "zep": zep, "jsonl": jsonl,
    "basic-memory": markdown_notes, "tool-log": tool_log,
}


def read(spark: SparkSession, kind: str, path: str, ns: str | None = None) -> DataFrame:
    return READERS[kind](spark, path, **({} if ns is None else {"ns": ns}))


def bundle(spark: SparkSession, path: str, until_hlc: int | None = None) -> DataFrame:
    """A bundle written as Parquet, up to a point in time (inclusive); read again it changes nothing."""
    df = spark.read.parquet(path)
    df = df if until_hlc is None else df.filter(F.col("hlc") <= until_hlc)
    return df.groupBy("hash").agg(F.max_by(F.struct(*[c for c in df.columns if c != "hash"]), "op_seq").alias("r")).select("hash", "r.*").filter("op <> 3")
