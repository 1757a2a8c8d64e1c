"""Task-side helpers: words of a column of texts as 64-bit hashes, without a Python object per word.

The module is shipped to the executors by value, so they need numpy and pyarrow only.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bytes of text hashed at once; a longer text makes its own slice.
SLICE = 1 << 20
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _C1
    x = x ^ (x >> np.uint64(27))
    x = x * _C2
    return x ^ (x >> np.uint64(31))


def _unshift(x: np.ndarray, by: int) -> np.ndarray:
    out, step = x.copy(), np.uint64(by)
    for _ in range(64 // by + 1):
        out = x ^ (out >> step)
    return out


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of ``mix``."""
    x = _unshift(x, 31) * np.uint64(pow(int(_C2), -1, 1 << 64))
    x = _unshift(x, 27) * np.uint64(pow(int(_C1), -1, 1 << 64))
    return _unshift(x, 30)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the ``len + 1`` offsets into them; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Cut rows into runs of at most ``most`` bytes (at least one row each)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def code_points(data: np.ndarray) -> np.ndarray:
    """``len + 1`` numbers: the code points before each byte."""
    return np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))


class Words:
    """The words of one slice: hash, number of the row, byte range (relative to ``data``)."""

    def __init__(self, hashes, row, start, end, data):
        self.hashes, self.row, self.start, self.end, self.data = hashes, row, start, end, data

    def __len__(self) -> int:
        return len(self.hashes)


class Hasher:
    """Splits texts at ASCII white space and hashes the words, A-Z as a-z unless ``exact``; with ``marks``
    every ASCII character but letters and digits separates words.

    The hash is a polynomial over random byte values, taken from running sums, so the cost is a few array
    operations per byte whatever the words are.
    """

    def __init__(self, exact: bool = False, marks: bool = False):
        low = np.arange(256, dtype=np.uint64)
        if not exact:
            low[65:91] += 32
        self.value = mix(low + np.uint64(1))
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        if marks:
            self.space[:128] = [not chr(b).isalnum() for b in range(128)]
        self._powers(1 << 12)

    def _powers(self, n: int) -> None:
        self.up = np.cumprod(np.full(n, _BASE, np.uint64))
        self.down = np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))

    def _ranges(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(data)
        if n > len(self.up):
            self._powers(max(n, min(2 * len(self.up), SLICE)))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[data] * self.up[:n], out=total[1:])
        if not len(start):
            return np.zeros(0, np.uint64)
        return mix((total[end] - total[start]) * self.down[start] + (end - start).astype(np.uint64))

    def words(self, data: np.ndarray, offsets: np.ndarray) -> Words:
        """Words of the rows whose texts lie between ``offsets`` in ``data``."""
        first = offsets[0]
        data, at = data[first : offsets[-1]], offsets - first
        n = len(data)
        solid = ~self.space[data]
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        begin = solid.copy()
        begin[1:] &= ~solid[:-1] | edge[1:n]
        stop = solid.copy()
        stop[:-1] &= ~solid[1:] | edge[1:n]
        start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        row = np.searchsorted(at, start, "right") - 1
        return Words(self._ranges(data, start, end), row, start, end, data)


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of the word n-grams; a row with fewer words has one gram of all of them."""
    h, row = words.hashes, words.row
    if not len(h):
        return h, row
    here = np.bincount(row)[row]
    first = np.searchsorted(row, row)
    at = np.arange(len(h)) - first
    size = np.minimum(here, n)
    whole = at + size <= here
    keep = np.flatnonzero(whole)
    out = np.full(len(keep), n, np.uint64)
    for j in range(n):
        use = j < size[keep]
        step = h[np.minimum(keep + j, len(h) - 1)]
        out = np.where(use, mix(out * np.uint64(0x100000001B3) + step), out)
    return out, row[keep]


def distinct(x: np.ndarray) -> np.ndarray:
    """The different numbers in ascending order, by one sort."""
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    keep[1:] = x[1:] != x[:-1]
    return x[keep]


def worker_state(name: str, make):
    """One object per Python worker process, made on first use and kept between tasks."""
    held = sys.modules.setdefault("_rankweave_worker", type(sys)("_rankweave_worker"))
    if name not in held.__dict__:
        held.__dict__[name] = make()
    return held.__dict__[name]
