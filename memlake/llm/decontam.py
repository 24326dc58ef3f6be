"""Benchmark decontamination by the q-gram lemma.

Items and texts are compared as bytes with A-Z lower-cased and white space
collapsed.  An item is cut into segments of SEGMENT bytes, half overlapping; a
segment of length n may differ from a text's region by at most
k = EDIT_RATE * n edits.  Each edit spoils q q-grams at most, so a region that
close shares at least n - q + 1 - k q q-grams with the segment, on diagonals at
most k apart.  The text's q-grams are looked up in the segments' and counted in
overlapping diagonal bands; bands that reach the bound are retained and
verified by a banded alignment.  Where the bound would fall below one, k is
lowered until it is one.

q-grams found in many segments are left out of a segment's own while its bound
stays positive; the bound then counts those that remain, so nothing is lost.

Items under Q bytes, which have no q-gram and no edit budget, are found exactly,
as whole words, by an automaton over all of them.

The benchmark is read in slices of SLICE_BYTES at most.  Each slice is sent to
the executors and the texts are scanned against it without a shuffle: one scan
for a benchmark of up to SLICE_BYTES.  For larger ones each slice's findings
are written out before the next slice, so that no task holds two.

Defined cases: null texts are empty; a null or blank item is in no text; an
item repeated in the benchmark, or several rows of one item_id, count as one;
an item with a null item_id is searched too: what it is found in has edits but
not its id; equal documents are judged alike, row by row; empty tables give no
hits; where docs has columns called _items or _edits, the new ones have more
underscores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk
from .store import cut, free_name, packed, unpacked

Q = 12
EDIT_RATE = 0.05
SEGMENT = 200
SLICE_BYTES = 4 << 20
COMMON = 4
_BITS = 22


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with each run of white space as one space, none at a text's ends."""
    n = len(data)
    if not n:
        return data, offsets
    out = tk.lower_ascii(data)
    space = tk._SPACE[out]
    out[space] = 0x20
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    keep &= ~(space & first[:-1])
    keep &= ~(space & first[1:])
    places = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], places[offsets]


def grams(data: np.ndarray) -> np.ndarray:
    """All Q-byte grams (8 < Q <= 16) as 64-bit integers, of which a few may stand for two grams; counts only grow by that."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    data = np.ascontiguousarray(data)
    n = len(data) - Q + 1
    view = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    with np.errstate(over="ignore"):
        out = view[:n] * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
        out += view[Q - 8 :][:n]
        out *= np.uint64(0xD6E8FEB86659FD93)
    return out


def _slot(g: np.ndarray) -> np.ndarray:
    return (g >> np.uint64(64 - _BITS)).astype(np.int64)


class Index:
    """The segments of some items, and where their q-grams stand."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float = EDIT_RATE):
        segments: dict[bytes, set[int]] = {}
        short: dict[str, set[int | None]] = {}
        for item, raw in items:
            data, _ = normalise(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            text = data.tobytes().strip(b" ")
            if len(text) < Q:
                if text:
                    short.setdefault(f" {text.decode('latin-1')} ", set()).add(item)
                continue
            starts = [0] if len(text) <= SEGMENT else [*range(0, len(text) - SEGMENT, SEGMENT // 2), len(text) - SEGMENT]
            for s in starts:
                segments.setdefault(text[s : s + SEGMENT], set()).add(item)
        self.texts = list(segments)
        self.items = [list(v) for v in segments.values()]
        self.short = None
        if short:
            import ahocorasick

            self.short = ahocorasick.Automaton()
            for text, found in short.items():
                self.short.add_word(text, list(found))
            self.short.make_automaton()
        self.edits = np.array([min(int(rate * len(t)), max(0, (len(t) - Q) // Q)) for t in self.texts], dtype=np.int64)
        at = [grams(np.frombuffer(t, np.uint8)) for t in self.texts]
        own = np.repeat(np.arange(len(at)), [len(x) for x in at]) if at else np.zeros(0, np.int64)
        pos = np.concatenate([np.arange(len(x)) for x in at]) if at else np.zeros(0, np.int64)
        code = np.concatenate(at) if at else np.zeros(0, np.uint64)
        uniq, inverse, spread = np.unique(code, return_inverse=True, return_counts=True)
        often = spread[inverse]
        keep = np.ones(len(code), dtype=bool)
        self.need = np.zeros(len(at), dtype=np.int64)
        begin = 0
        for i, x in enumerate(at):
            mine = np.arange(begin, begin + len(x))
            begin += len(x)
            least = 1 + int(self.edits[i]) * Q
            rare = often[mine] <= COMMON
            spare = len(x) - least
            common = mine[~rare]
            if len(common) > spare:  # drop only the most common that can be spared
                common = common[np.argsort(-often[common], kind="stable")][: max(spare, 0)]
            keep[common] = False
            self.need[i] = len(x) - len(common) - int(self.edits[i]) * Q
        code, own, pos = code[keep], own[keep], pos[keep]
        order = np.argsort(code, kind="stable")
        self.code, first, count = np.unique(code[order], return_index=True, return_counts=True)
        self.first, self.count, self.own, self.pos = first, count, own[order], pos[order]
        self.bitmap = np.zeros(1 << _BITS, dtype=bool)
        self.bitmap[_slot(self.code)] = True

    def regions(self, data: np.ndarray) -> list[tuple[int, int, int]]:
        """(segment, lowest and highest diagonal) of the retained bands over all of data."""
        g = grams(data)
        at = np.flatnonzero(self.bitmap[_slot(g)])
        if not len(at) or not len(self.code):
            return []
        k = np.searchsorted(self.code, g[at])
        k[k == len(self.code)] = 0
        same = self.code[k] == g[at]
        at, k = at[same], k[same]
        times = self.count[k]
        total = int(times.sum())
        if not total:
            return []
        inner = np.arange(total) - np.repeat(np.cumsum(times) - times, times)
        entry = np.repeat(self.first[k], times) + inner
        segment = self.own[entry]
        diagonal = np.repeat(at, times) - self.pos[entry] + SEGMENT
        band = 2 * self.edits[segment] + 2
        out: set[tuple[int, int, int]] = set()
        for shift in (0, 1):
            b = (diagonal + shift * (band // 2)) // band
            key = segment * (1 << 40) + b
            key, n = np.unique(key, return_counts=True)
            s, b = key >> 40, key & ((1 << 40) - 1)
            for i in np.flatnonzero(n >= self.need[s]):
                w = int(2 * self.edits[s[i]] + 2)
                low = int(b[i]) * w - shift * (w // 2) - SEGMENT
                out.add((int(s[i]), low, low + w - 1))
        return sorted(out)

    def distance(self, segment: int, data: np.ndarray, low: int, high: int) -> int:
        """Least edits between the segment and any region of data on diagonals low - k to high + k; over k if none is that close."""
        t, k = self.texts[segment], int(self.edits[segment])
        begin, end = max(0, low - k), min(len(data), high + len(t) + k)
        region = data[begin:end]
        if region.tobytes().find(t) >= 0:
            return 0
        if not k:
            return 1
        pattern = np.frombuffer(t, np.uint8)
        # cell j of row i: pattern[:i] against a region's part that ends on diagonal (low - k) + j
        base, width = low - k - begin, high - low + 2 * k + 1
        far = len(t) + 1
        row = np.zeros(width, dtype=np.int64)
        step = np.arange(width)
        padded = np.full(len(t) + width + 2, 256, dtype=np.int64)
        lo = max(0, base)
        padded[lo - base : lo - base + max(0, min(len(region), base + len(padded)) - lo)] = region[lo : base + len(padded)]
        outside = lambda i: (base + i + step < 0) | (base + i + step > len(region))
        row[outside(0)] = far
        for i in range(1, len(t) + 1):
            match = row + (padded[i - 1 : i - 1 + width] != pattern[i - 1])
            gap = np.append(row[1:], far) + 1
            best = np.minimum(match, gap)
            best = np.minimum.accumulate(best - step) + step
            best[outside(i)] = far
            row = np.minimum(best, far)
            if row.min() > k:
                return far
        return int(row.min())

    def hits(self, block: tk.Block) -> dict[int, dict[int, int]]:
        """For each text number with any: the items found and their least edits."""
        data, offsets = normalise(block.data, block.offsets)
        out: dict[int, dict[int, int]] = {}
        if self.short is not None:
            raw = data.tobytes().decode("latin-1")
            for d in range(len(block)):
                for _, found in self.short.iter(f" {raw[offsets[d] : offsets[d + 1]]} "):
                    for item in found:
                        out.setdefault(d, {})[item] = 0
        for segment, low, high in self.regions(data):
            middle = max(0, min(len(data) - 1, (low + high + len(self.texts[segment])) // 2))
            for d in {int(np.searchsorted(offsets, x, side="right")) - 1 for x in (max(0, low), middle, min(len(data) - 1, max(0, high + len(self.texts[segment]) - 1)))}:
                if d >= len(block):
                    continue
                a, b = offsets[d], offsets[d + 1]
                edits = self.distance(segment, data[a:b], low - a, high - a)
                if edits <= self.edits[segment]:
                    for item in self.items[segment]:
                        mine = out.setdefault(d, {})
                        mine[item] = min(edits, mine.get(item, edits))
        return out


def _slices(benchmark: DataFrame) -> Iterator[list[tuple[int | None, bytes]]]:
    """The benchmark's items in lists of at most SLICE_BYTES, one at a time on the driver."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.encode("text", "utf-8").alias("b")).filter("b is not null")
    part, size = [], 0
    for r in rows.toLocalIterator():
        part.append((r["item_id"], bytes(r["b"])))
        size += len(r["b"])
        if size >= SLICE_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs and last two columns more: _items (item_ids found in the text, ascending) and _edits (the least edits of any, else null)."""
    from pyspark.sql import types as T

    names, docs = docs.columns, packed(docs, "text")
    items_as, edits_as = free_name(names, "_items"), free_name(names, "_edits")
    spark, out = docs.sparkSession, docs.withColumns({"_items": F.array().cast("array<bigint>"), "_edits": F.lit(None).cast("int")})
    schema = out.schema
    for n, part in enumerate(_slices(benchmark)):
        if n:
            out, _ = cut(out)
        shared = spark.sparkContext.broadcast(Index(part))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                found: list[dict[int, int]] = []
                for block in tk.blocks(batch.column("text")):
                    hits = index.hits(block)
                    found += [hits.get(i, {}) for i in range(len(block))]
                before, edits = batch.column("_items").to_pylist(), batch.column("_edits").to_pylist()
                items = [sorted({*(b or ()), *f} - {None}) for b, f in zip(before, found, strict=True)]
                least = [min([*f.values(), *([e] if e is not None else [])], default=None) for e, f in zip(edits, found, strict=True)]
                rest = {c: batch.column(c) for c in batch.schema.names if c not in ("_items", "_edits")}
                yield pa.RecordBatch.from_pydict(rest | {"_items": pa.array(items, pa.list_(pa.int64())), "_edits": pa.array(least, pa.int32())})

        out = out.mapInArrow(run, T.StructType(schema.fields))
    return out.select(*unpacked(docs, names), F.col("_items").alias(items_as), F.col("_edits").alias(edits_as))
