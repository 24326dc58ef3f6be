"""Hashed n-gram indicators of whole texts, as one array per block of texts."""

from __future__ import annotations

import numpy as np

from . import textkit as tk

DIMS = 1 << 16

# byte classes: A-Z, a-z and non-ASCII, digits, symbols, ! and ?, other marks
_CLASS = np.full(256, 32, dtype=np.uint8)
_CLASS[0x41:0x5B] = 1
_CLASS[0x61:0x7B] = 2
_CLASS[0x80:] = 2
_CLASS[0x30:0x3A] = 4
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 8
_CLASS[[ord(c) for c in "!?"]] = 16
_LETTER = (_CLASS == 1) | (_CLASS == 2) | (_CLASS == 4)


def _place(codes: np.ndarray, kind: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (tk.mix(codes.astype(np.uint64) + np.uint64(kind) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(DIMS - 1)).astype(np.int64)


def _distinct(owner: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places by text: (owner, place), ascending."""
    key = owner.astype(np.int64) << 16
    key |= place
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return key >> 16, key & (DIMS - 1)


def style(block: tk.Block) -> tuple[np.ndarray, np.ndarray]:
    """For quality: byte trigrams, word-shape trigrams and binned shares of shapes.

    A word's shape is the set of byte classes in it, with a bit for being the
    same as the word before.  An empty text has the one feature of its size.
    """
    n, data, off = len(block), block.data, block.offsets
    owners, places = [], []
    if len(data) > 2:
        code = data[:-2].astype(np.uint32) << 16 | data[1:-1].astype(np.uint32) << 8 | data[2:]
        own = np.repeat(np.arange(n), np.diff(off))[:-2]
        ok = np.repeat(off[1:], np.diff(off))[:-2] - np.arange(len(code)) >= 3
        owners.append(own[ok])
        places.append(_place(code[ok], 1))
    s, e, o = tk.words(data, off)
    length = np.bincount(o, minlength=n)
    if len(s):
        # classes of each word: or over its bytes
        ors = np.bitwise_or.reduceat(np.append(_CLASS[data], np.uint8(0)), np.stack([s, e], 1).ravel())[::2]
        h = tk.span_hashes(data, s, e)
        same = np.zeros(len(s), dtype=bool)
        same[1:] = (h[1:] == h[:-1]) & (o[1:] == o[:-1])
        shape = ors.astype(np.int64) | same.astype(np.int64) << 6
        if len(s) > 2:
            tri = shape[:-2] << 14 | shape[1:-1] << 7 | shape[2:]
            ok = o[:-2] == o[2:]
            owners.append(o[:-2][ok])
            places.append(_place(tri[ok], 2))
        sh, so = tk.shingles(h, o, n, 4)
        order = np.lexsort((sh, so))
        twice = np.zeros(len(sh), dtype=bool)
        twice[1:] = (sh[order][1:] == sh[order][:-1]) & (so[order][1:] == so[order][:-1])
        shares = [np.bincount(o, weights=(shape >> k & 1), minlength=n) / np.maximum(length, 1) for k in range(7)]
        shares.append(np.bincount(so[order], weights=twice, minlength=n) / np.maximum(np.bincount(so, minlength=n), 1))
        for k, share in enumerate(shares):
            for t, edge in enumerate((0.0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.8)):
                at = np.flatnonzero(share > edge)
                owners.append(at)
                places.append(_place(np.full(len(at), k << 8 | t), 3))
    owners.append(np.arange(n))
    places.append(_place(np.minimum(np.log2(length + 1).astype(np.int64), 12), 4))
    return _distinct(np.concatenate(owners), np.concatenate(places), n)


def vocabulary(block: tk.Block) -> tuple[np.ndarray, np.ndarray]:
    """For toxicity: lower-cased letter runs, their first four and five bytes."""
    n, data, off = len(block), tk.lower_ascii(block.data), block.offsets
    marks = np.where(_LETTER[data], data, np.uint8(0x20))
    s, e, o = tk.words(marks, off)
    owners, places = [np.arange(n)], [_place(np.zeros(n), 9)]
    if len(s):
        h = tk.span_hashes(data, s, e)
        owners.append(o)
        places.append(_place(h, 5))
        for cut in (4, 5):
            long = e - s > cut
            owners.append(o[long])
            places.append(_place(tk.span_hashes(data, s[long], s[long] + cut), cut + 2))
    return _distinct(np.concatenate(owners), np.concatenate(places), n)


def split(owner: np.ndarray, place: np.ndarray, n: int) -> list[np.ndarray]:
    ends = np.cumsum(np.bincount(owner, minlength=n))
    return np.split(place, ends[:-1])
