"""Vectorised words of a batch of texts: spans, hashes and word shingles, without a Python loop over words."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@functools.lru_cache(maxsize=4)
def _letters(seed: int) -> np.ndarray:
    t = mix(np.arange(1, 257, dtype=np.uint64) * _ODD + np.uint64(seed))
    t[_IS_SPACE] = 0
    return t[_LOWER]


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.uint64(0xB5297A4D9E3779B9)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    p, q = np.full(n, base), np.full(n, inverse)
    p[0] = q[0] = 1
    return np.multiply.accumulate(p), np.multiply.accumulate(q)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2^64."""
    size = 1 << max(16, (max(1, n) - 1).bit_length())
    p, q = _powers(size)
    return p[:n], q[:n]


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column without nulls, and the offset of each text (one more at the end)."""
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    bufs = col.buffers()
    offsets = np.frombuffer(bufs[1], kind, len(col) + 1, col.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words (runs of bytes outside ``[\\x20\\x09-\\x0D]``, A-Z lowered) of a slice of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, n = data, offsets, len(data)
        space = _IS_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        first = ~space
        first[1:] &= space[:-1] | edge[1:n]
        last = ~space
        last[:-1] &= space[1:] | edge[1:n]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)  # first word of each text
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bounds))

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64-bit hash of each lowered word."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        p, q = powers(len(self.data))
        sums = np.add.reduceat(_letters(seed)[self.data] * p, self.starts)
        return mix(sums * q[self.starts])

    def shingles(self, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """(text index, hash) of every run of ``size`` words; a shorter text gives one run of all its words."""
        h = self.hashes()
        n = len(h)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        p, q = powers(n)
        prefix = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(h * p)))
        count = np.diff(self.bounds)
        runs = np.where(count > 0, np.maximum(count - size + 1, 1), 0)
        doc = np.repeat(np.arange(len(count)), runs)
        within = np.arange(len(doc)) - np.repeat(runs.cumsum() - runs, runs)
        start = self.bounds[doc] + within
        end = np.minimum(start + size, self.bounds[doc + 1])
        return doc, mix((prefix[end] - prefix[start]) * q[start] + (end - start).astype(np.uint64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted: (bounds by text, hashes)."""
    doc, h = Words(data, offsets).shingles(size)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    doc, h = doc[keep], h[keep]
    return np.searchsorted(doc, np.arange(len(offsets))), h
