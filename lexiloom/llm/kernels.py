"""Vectorised text kernels over Arrow batches.

All functions work on the raw UTF-8 buffer of a whole slice of rows at once, so no
Python-level loop runs per word or per character. Words are maximal runs of bytes outside
``[\\x20\\x09-\\x0D]``; those bytes never occur inside a multi-byte UTF-8 character, so the
byte view and the character view give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = b" \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACE)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes handled at once; a single longer document is handled alone.
SLICE = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_rng = np.random.Generator(np.random.PCG64(20240917))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if n > 4 * SLICE:  # an exceptionally long document: not kept
        return _make_powers(n)
    if 0 not in _POWERS or len(_POWERS[0][0]) < n:
        _POWERS[0] = _make_powers(max(n, SLICE + 1))
    return _POWERS[0]


def _make_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(n, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the row offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(at):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


class Words:
    """The words of a run of rows: ``start``, ``end`` (bytes) and ``first`` (rows -> words)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, gap: np.ndarray = IS_SPACE):
        """``gap`` marks the bytes between words."""
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        n = len(data)
        if not n:
            self.start = self.end = np.zeros(0, np.int64)
            self.first = np.zeros(len(offsets), np.int64)
            return
        space = gap[data]
        before, after = np.empty(n, bool), np.empty(n, bool)
        before[0] = after[-1] = True
        before[1:], after[:-1] = space[:-1], space[1:]
        full = offsets[1:] > offsets[:-1]
        before[offsets[:-1][full]] = True
        after[offsets[1:][full] - 1] = True
        np.logical_not(space, out=space)
        self.start = np.flatnonzero(before & space)
        self.end = np.flatnonzero(after & space) + 1
        self.first = np.searchsorted(self.start, offsets)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        power, inverse = _powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * power[: len(self.data)], out=total[1:])
        return mix((total[self.end] - total[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive word hashes, across rows too."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power[: len(h)], out=total[1:])
    return mix((total[k:] - total[:-k]) * inverse[: len(h) - k + 1] + np.uint64(k))


def row_of(first: np.ndarray) -> np.ndarray:
    """For each word, its row."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def batches(source: Iterator[pa.RecordBatch], column: str, most: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Splits batches into slices of bounded bytes: (rows, bytes, offsets)."""
    for batch in source:
        data, at = buffer(batch.column(column))
        for i, j in slices(at, most):
            yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]
