"""The bounded labelled sample that the classifiers learn from, and scoring by blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import textkit as tk
from .features import DIMS, split

BLOCK_BYTES = 1 << 20  # of text whose features are held at a time
SAMPLE_BYTES = 128 << 20  # of features that a fit reads at most

Extract = Callable[[tk.Block], tuple[np.ndarray, np.ndarray]]


def remainder(key: Column, by: int) -> Column:
    """crc32 of key as text, modulo by; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % by


def sample(docs: DataFrame, labels: DataFrame, names: list[str], extract: Extract, bound: int, usable: Column, stratum: str | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature rows and labels of at most bound labelled documents (by stratum value if given) and SAMPLE_BYTES, chosen by hash.

    The first of names must be known; others that are null are -1.

    The chosen labels are bounded, so they are broadcast and the texts are
    scanned once without a shuffle; contrary or repeated labels of a document
    count as its largest.
    """
    agreed = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.max(c).alias(c) for c in names])
    agreed = agreed.filter(usable).dropna(subset=names[:1]).fillna(-1, names)
    order = [F.xxhash64("doc_id", F.lit(3)), F.col("doc_id")]
    if stratum is None:
        chosen = agreed.orderBy(*order).limit(bound)
    else:
        chosen = None
        for value in (0, 1):
            part = agreed.filter(F.col(stratum) == value).orderBy(*order).limit(bound)
            chosen = part if chosen is None else chosen.unionByName(part)
    chosen = chosen.withColumnsRenamed({c: f"_y{i}" for i, c in enumerate(names)}).withColumnRenamed("doc_id", "_id")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    one = texts.groupBy("doc_id", *[f"_y{i}" for i in range(len(names))]).agg(F.min("text").alias("text"))
    width = len(names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tk.blocks(batch.column("text"), BLOCK_BYTES):
                own, place = extract(block)
                packed = [p.astype(np.uint16).tobytes() for p in split(own, place, len(block))]
                at = slice(block.first, block.first + len(block))
                cols = {"doc_id": batch.column("doc_id")[at], "x": pa.array(packed, pa.binary())}
                yield pa.RecordBatch.from_pydict(cols | {f"_y{i}": batch.column(f"_y{i}")[at].cast(pa.int32()) for i in range(width)})

    schema = "doc_id long, x binary" + "".join(f", _y{i} int" for i in range(width))
    got, size = [], 0
    for r in one.mapInArrow(rows, schema).repartitionByRange(8, *order).sortWithinPartitions(*order).toLocalIterator():
        size += len(r["x"])
        if size > SAMPLE_BYTES:
            break
        got.append(r)
    got.sort(key=lambda r: r["doc_id"])
    x = [np.frombuffer(r["x"], np.uint16).astype(np.int64) for r in got]
    return x, np.array([[r[f"_y{i}"] for i in range(width)] for r in got], dtype=np.int64).reshape(len(got), width)


def scored(docs: DataFrame, extract: Extract, score: Callable[[np.ndarray, np.ndarray, int], dict[str, np.ndarray]], names: list[str]) -> DataFrame:
    """doc_id and score's columns for every row of docs: one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tk.blocks(batch.column("text"), BLOCK_BYTES):
                own, place = extract(block)
                out = score(own, place, len(block))
                ids = batch.column("doc_id")[block.first : block.first + len(block)]
                yield pa.RecordBatch.from_pydict({"doc_id": ids} | {c: pa.array(out[c], pa.float64()) for c in names})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long" + "".join(f", {c} double" for c in names))


__all__ = ["DIMS", "remainder", "sample", "scored"]
