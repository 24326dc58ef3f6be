"""Shared tables for intermediate results.

Lineage is cut by writing Parquet below spark.checkpoint.dir, the folder that
driver and executors share, so a lost executor costs nothing already written.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local master may do without it, and gets a folder of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="memlake-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


@contextlib.contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    """What is executed within removes its shuffle files at its end, not when the driver next collects its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> tuple[DataFrame, str]:
    """df written to the shared folder and read again, and where it is; its shuffles are gone then."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/memlake-{uuid.uuid4().hex}"
    with _shuffles_end(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Remove tables written by cut()."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
