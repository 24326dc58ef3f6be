"""Line dedup by content-defined line chunks.

A hash rolling over the hashes of the last WINDOW lines ends a chunk wherever
it is less than at the line before and after, so boundaries depend on the lines
near them only and come back, however far a passage is shifted, and no two
boundaries, nor a boundary and a text's end, are one line apart.  A line of
LONG_LINE words or more is a chunk of its own.  A chunk can be removed if it has two lines or more that
are not blank, or is such a long line; of all its occurrences in all documents
the first, in the document of the smallest doc_id (null last; of equal ones
the smallest text hash), stays.

Repeated chunks are found by grouping on the chunk's bytes, so equal means
byte-equal; the verified groups go back to the documents by the chunks' 128-bit
digest.  Copies are summed where they lie, thus a chunk that a third of all
rows share costs one row per task.  The documents' texts are shuffled twice, as
chunks and for the join with the removals.

Defined cases: null text stays null; a text without lines to remove is returned
byte for byte; equal rows of one doc_id count as one document and are treated
alike, rows of one doc_id (or of null) with different texts as different
documents, so that no list grows with the rows that share an id; other columns
stay, and where one is called like a new one, the new one gets underscores
before it; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk
from .store import cut, free_name, packed, unpacked

WINDOW = 2
BYTES = 1 << 20
LONG_LINE = 20


def line_spans(block: tk.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (without the line feed) and text number of every line."""
    feeds = np.flatnonzero(block.data == 10)
    starts = np.concatenate([block.offsets[:-1], feeds + 1])
    own = np.concatenate([np.arange(len(block)), np.searchsorted(block.offsets, feeds, side="right") - 1])
    order = np.lexsort((starts, own))
    starts, own = starts[order], own[order]
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    last = np.append(own[1:] != own[:-1], True) if len(own) else np.zeros(0, bool)
    ends[last] = block.offsets[1:]
    return starts, ends, own


def chunks(block: tk.Block) -> list[list[tuple[int, int, int, bool]]]:
    """For each text its chunks as (start, end, lines, removable)."""
    starts, ends, own = line_spans(block)
    word_at, _, _ = tk.words(block.data, block.offsets)
    n_words = np.searchsorted(word_at, ends) - np.searchsorted(word_at, starts)
    h = tk.span_hashes(block.data, starts, ends)
    with np.errstate(over="ignore"):
        roll = h.copy()
        for j in range(1, WINDOW):
            # each text's roll starts afresh, so its chunks are the same whatever stands before it in a batch
            roll[j:] += np.where(own[j:] == own[:-j], h[:-j] * np.uint64(0x9E3779B97F4A7C15 + 2 * j), np.uint64(0))
    # a line's roll is the least of three, with one line of its text before the three's last and two after it
    value, stop = tk.mix(roll), np.zeros(len(roll), dtype=bool)
    if len(roll) > 3:
        mid = value[1:-2]
        stop[1:-2] = (mid < value[:-3]) & (mid <= value[2:-1]) & (own[:-3] == own[3:])
    long = n_words >= LONG_LINE
    stop |= long
    stop[:-1] |= long[1:] | (own[1:] != own[:-1])
    if len(stop):
        stop[-1] = True
    to = np.flatnonzero(stop)
    at = np.concatenate([[0], to[:-1] + 1]) if len(to) else to
    solid = np.concatenate([[0], np.cumsum(n_words > 0)])
    ok = (solid[to + 1] - solid[at] >= 2) | long[at]
    out: list[list[tuple[int, int, int, bool]]] = [[] for _ in range(len(block))]
    for o, s, e, k, good in zip(own[at].tolist(), starts[at].tolist(), ends[to].tolist(), (to - at + 1).tolist(), ok.tolist(), strict=True):
        out[o].append((s, e, k, good))
    return out


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in tk.blocks(batch.column("text"), BYTES):
            raw = block.data.tobytes()
            rows, digests, texts, counts = [], [], [], []
            for i, found in enumerate(chunks(block)):
                seen: dict[bytes, int] = {}
                for s, e, _, ok in found:
                    if ok:
                        d = xxhash.xxh3_128_digest(raw[s:e])
                        if d in seen:
                            counts[seen[d]] += 1
                            continue
                        seen[d] = len(counts)
                        rows.append(block.first + i)
                        digests.append(d)
                        texts.append(raw[s:e])
                        counts.append(1)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(pa.array(rows, pa.int64())), "_at": batch.column("_at").take(pa.array(rows, pa.int64())), "digest": pa.array(digests, pa.binary()), "chunk": pa.array(texts, pa.binary()), "n": pa.array(counts, pa.int64())})


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("text")
        gone, once = batch.column("_gone"), batch.column("_once")
        new, removed, total = [], [], []
        for block in tk.blocks(text, BYTES):
            raw = block.data.tobytes()
            found = chunks(block)
            for i in range(len(block)):
                at = block.first + i
                mine = raw[block.offsets[i] : block.offsets[i + 1]]
                drop, keep_one = set(gone[at].as_py() or ()), set(once[at].as_py() or ())
                kept, n_gone = [], 0
                if drop or keep_one:
                    seen = set()
                    for s, e, k, ok in found[i]:
                        d = xxhash.xxh3_128_digest(raw[s:e]) if ok else None
                        if d is not None and (d in drop or d in seen):
                            n_gone += k
                            continue
                        if d in keep_one:
                            seen.add(d)
                        kept.append(raw[s:e])
                    mine = b"\n".join(kept) if n_gone else mine
                total.append(sum(k for _, _, k, _ in found[i]))
                removed.append(n_gone)
                new.append(mine if text[at].is_valid else None)
        rest = {c: batch.column(c) for c in batch.schema.names if c not in ("text", "_gone", "_once")}
        yield pa.RecordBatch.from_pydict(rest | {"text": pa.array(new, pa.binary()).cast(pa.string()), "_lines": pa.array(total, pa.int64()), "_removed": pa.array(removed, pa.int64())})


def dedup_lines(docs: DataFrame, lines: str = "n_lines", removed: str = "n_removed") -> DataFrame:
    """docs with repeated chunks taken out of text, and last two columns more: lines before, and lines removed."""
    from pyspark.sql import types as T

    at = F.xxhash64("text")  # with doc_id it names a document
    found = docs.select("doc_id", "text", at.alias("_at")).mapInArrow(tk.lean(_emit), "doc_id long, _at long, digest binary, chunk binary, n long")
    name = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "_at")
    groups = found.groupBy("digest", "chunk").agg(F.sum("n").alias("n"), F.min(name).alias("owner"))
    repeated, _ = cut(groups.filter("n > 1").select(F.col("digest").alias("_d"), "owner"))
    hits = found.select("doc_id", "_at", "digest").join(repeated, F.col("digest") == F.col("_d"))
    own = F.col("doc_id").eqNullSafe(F.col("owner.doc_id")) & (F.col("_at") == F.col("owner._at"))
    # sets, as equal rows find the same; a set is no larger than one text's chunks
    per = hits.groupBy(F.col("doc_id").alias("_id"), F.col("_at").alias("_own")).agg(F.collect_set(F.when(~own, F.col("digest"))).alias("_gone"), F.collect_set(F.when(own, F.col("digest"))).alias("_once"))
    rows = packed(docs, "doc_id", "text")
    joined = rows.join(per, rows["doc_id"].eqNullSafe(per["_id"]) & (F.xxhash64(rows["text"]) == per["_own"]), "left").drop("_id", "_own")
    schema = T.StructType([rows.schema["doc_id"], rows.schema["_rest"], rows.schema["text"], T.StructField("_lines", T.LongType()), T.StructField("_removed", T.LongType())])
    out = joined.mapInArrow(tk.lean(_rebuild), schema)
    return out.select(*unpacked(rows, docs.columns), F.col("_lines").alias(free_name(docs.columns, lines)), F.col("_removed").alias(free_name(docs.columns, removed)))
