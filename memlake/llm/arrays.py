"""Arrays as compressed bytes, for rows that carry many small values."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes, whole numbers in the least width."""
    parts = [np.uint32(len(arrays)).tobytes()]
    for a in arrays:
        if a.dtype.kind in "iu" and a.dtype.itemsize > 1 and a.dtype != np.uint64 and a.dtype != np.int64 or a.dtype == np.int64 and (not len(a) or a.min() >= 0):
            top = int(a.max()) if len(a) else 0
            a = a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.int64)
        parts.append(np.array([ord(a.dtype.char), len(a)], dtype=np.int64).tobytes())
        # a value's bytes apart: those that hardly change are next to each other
        parts.append((np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T if a.dtype.itemsize > 1 else a).tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpack(raw: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n, at, out = int(np.frombuffer(raw, np.uint32, 1)[0]), 4, []
    for _ in range(n):
        kind, size = np.frombuffer(raw, np.int64, 2, at).tolist()
        dtype = np.dtype(chr(kind))
        flat = np.frombuffer(raw, np.uint8, size * dtype.itemsize, at + 16)
        out.append(np.ascontiguousarray(flat.reshape(dtype.itemsize, size).T).view(dtype).ravel() if size else np.zeros(0, dtype))
        at += 16 + size * dtype.itemsize
    return out
