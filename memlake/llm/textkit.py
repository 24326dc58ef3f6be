"""Vectorised text kernels over Arrow string buffers.

Words are maximal runs of bytes other than space and 0x09-0x0D.  All routines
work on the raw UTF-8 bytes of a block of texts at a time, so their cost is a
few numpy passes and never a Python loop over words.  Null texts are empty.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 4 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 18 if have is None else 2 * len(have))
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts[i]:ends[i]], from one prefix sum."""
    n = len(data)
    with np.errstate(over="ignore"):
        prefix = np.empty(n + 1, dtype=np.uint64)
        prefix[0] = 0
        weighted = data.astype(np.uint64)
        weighted += np.uint64(1)
        weighted *= _power_table(_P, n)
        np.cumsum(weighted, out=prefix[1:])
        h = prefix[ends] - prefix[starts]
        h *= _power_table(_P_INV, n + 1)[starts]
        h += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(h)


@dataclass
class Block:
    """Some consecutive texts: their bytes and n + 1 offsets into them, with the row numbers of the first and last."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def blocks(texts: pa.Array | pa.ChunkedArray, max_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts in blocks of about max_bytes; a longer text is a block of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, off, raw = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1)
        to = min(to, n)
        yield Block(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(run: Run) -> Run:
    """run, after which the memory that it has freed goes back to the system: a worker lives on between tasks and stages."""

    @functools.wraps(run)
    def leaner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)

    return leaner


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = np.empty(n + 2, dtype=bool)
    solid[0] = solid[-1] = False
    np.logical_not(_SPACE[data], out=solid[1:-1])
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | first[:-1]))
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def counts_per_text(owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, minlength=n)


def shingles(word_hash: np.ndarray, owner: np.ndarray, n_texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, with their text numbers.

    A text of 1 to k - 1 words gives its whole sequence as one shingle; a text
    without words gives none.
    """
    total = len(word_hash)
    lengths = np.bincount(owner, minlength=n_texts)
    begins = np.cumsum(lengths) - lengths
    with np.errstate(over="ignore"):
        acc = np.zeros(total, dtype=np.uint64)
        for j in range(min(k, total)):
            part = word_hash[j:] * np.uint64(2 * j + 0x9FB21C651E98DF25)
            part ^= part >> np.uint64(29)
            acc[: total - j] += part * np.uint64((0xA0761D6478BD642F + 2 * j) | 1)
    left = lengths[owner] - (np.arange(total) - begins[owner])
    full = left >= k
    hashes, at = acc[full], owner[full]
    small = np.flatnonzero((lengths > 0) & (lengths < k))
    if len(small):
        # the words of a short text, mixed with their positions and their number
        pos = np.arange(total) - begins[owner]
        mine = np.flatnonzero((lengths[owner] < k))
        with np.errstate(over="ignore"):
            parts = mix(word_hash[mine] + np.uint64(0xC2B2AE3D27D4EB4F) * (pos[mine] + 1).astype(np.uint64))
            sums = np.zeros(n_texts, dtype=np.uint64)
            np.add.at(sums, owner[mine], parts)
            extra = sums[small] + lengths[small].astype(np.uint64) * np.uint64(0x165667B19E3779F9)
        hashes, at = np.concatenate([hashes, extra]), np.concatenate([at, small])
    return mix(hashes), at


def distinct_per_text(hashes: np.ndarray, owner: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text, ascending, as one array with n_texts + 1 offsets."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    if len(h):
        keep = np.ones(len(h), dtype=bool)
        keep[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        h, o = h[keep], o[keep]
    offsets = np.zeros(n_texts + 1, dtype=np.int64)
    np.cumsum(np.bincount(o, minlength=n_texts), out=offsets[1:])
    return h, offsets
