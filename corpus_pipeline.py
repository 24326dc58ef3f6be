"""A training corpus from documents: five stages, each a library operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from memlake.llm import decontam, lines, mixing, nearjoin, quality
from memlake.llm.store import cut, drop, free_name


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of the threshold table."""
    return quality.passing(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go; so do documents of which no word is left."""
    out = lines.dedup_lines(docs)
    gone = F.col(f"`{out.columns[-1]}`")
    out = out.filter((gone == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    length = F.when(gone > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", length).select(*docs.columns)


def near_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id.

    Where doc_ids are null or repeated, rows are numbered, and of each group the
    row with the smallest number stays.
    """
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("doc_id is null or n > 1").isEmpty():
        keep = nearjoin.near_join(docs).filter("doc_id = component_id").select("doc_id")
        return docs.join(keep, "doc_id", "left_semi").select(*docs.columns)
    key = free_name(docs.columns, "_row")
    rows, _ = cut(docs.withColumn(key, F.monotonically_increasing_id()))
    found = nearjoin.near_join(rows.select(F.col(key).alias("doc_id"), "text"))
    keep = found.filter("doc_id = component_id").select(F.col("doc_id").alias(key))
    return rows.join(keep, key, "left_semi").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(F.col(f"`{found.columns[-1]}`").isNull()).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it, with its copy number."""
    return mixing.mixed(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_join", near_join), ("decontaminate", decontaminate), ("mix", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's result written and read again; a stage's input goes when its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs, path = cut(docs)
            if before is not None:
                drop(spark, before)
            before = path
    return docs


#: Rolling hashes, banded alignment and hash thresholds have no SQL equivalent; tests/llm compares with brute force.
ORACLE_SQL = None
