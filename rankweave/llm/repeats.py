"""Periodic runs of words in a text, by maximal pairs from the LCP-interval tree.

A run is a stretch of words with smallest period q (words q apart are equal) of at least ``least`` words and
``times`` periods, which no neighbouring word extends.  With length L it is the pair of the stretches of L - q words
that begin at its start and q later: equal, with different words before and different words behind, a maximal pair.
Seen from the other end, a maximal pair of l words at a distance of q is a run with period q if
q <= l / (times - 1) and l + q >= least, and needs no extension.

Maximal pairs come bottom-up from the LCP-interval tree of the text's suffix array: two positions in different
children of a node with l words agree in just l words, and if the words before them differ the pair is maximal.
A node holds its positions in order, each with the class of the word before it.  Children are merged smaller into
larger.  A stretch of two or more periods overlaps its next occurrence by a period, so the smallest period of a
run is the distance of neighbours in that order, and only the new neighbours of a position are looked at.

Pairs shorter than ``least * (times - 1) / times`` words, 16, fulfil neither bound, so a text without a repeated
16-gram has no run and nodes of fewer words are never built.

Every text is worked on in the task that reads it: nothing is shuffled, whatever copies or sources there are.
"""

from __future__ import annotations

import hashlib
import re
import sys
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.llm import text as words

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST, TIMES = 24, 3
WORD = re.compile(r"[^\x20\x09-\x0D]+")
# Words of texts that are looked at together, and the places of a block in a node's list.
TOGETHER, BLOCK = 1 << 20, 1 << 9


class Places:
    """Positions in order, in blocks by their value, so that adding one to a long list stays cheap."""

    def __init__(self, first: int):
        self.size, self.blocks, self.names = 1, {first // BLOCK: [first]}, [first // BLOCK]

    def add(self, p: int) -> tuple[int, int]:
        """Put ``p`` in; the positions before and behind it, -1 where there is none."""
        name = p // BLOCK
        self.size += 1
        block = self.blocks.get(name)
        if block is None:
            at = bisect_left(self.names, name)
            before = self.blocks[self.names[at - 1]][-1] if at else -1
            behind = self.blocks[self.names[at]][0] if at < len(self.names) else -1
            self.blocks[name] = [p]
            insort(self.names, name)
            return before, behind
        i = bisect_left(block, p)
        if 0 < i < len(block):
            before, behind = block[i - 1], block[i]
        else:
            at = bisect_left(self.names, name)
            before = block[i - 1] if i else (self.blocks[self.names[at - 1]][-1] if at else -1)
            behind = block[i] if i < len(block) else (self.blocks[self.names[at + 1]][0] if at + 1 < len(self.names) else -1)
        block.insert(i, p)
        return before, behind

    def __iter__(self) -> Iterator[int]:
        for name in self.names:
            yield from self.blocks[name]


def suffix_order(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array, and words that each suffix shares with the one before it in that order (the first: 0).

    Ranks by the first 1, 2, 4, ... words, until all differ; the common length is then read from the ranks,
    longest step first.
    """
    n = len(ids)
    ranks = [np.unique(ids, return_inverse=True)[1].astype(np.int64) + 1]
    while True:
        now, step = ranks[-1], 1 << (len(ranks) - 1)
        if n == 0 or now.max() == n or step >= n:
            break
        after = np.zeros(n, np.int64)
        after[:-step] = now[step:]
        ranks.append(np.unique(now * (n + 1) + after, return_inverse=True)[1].astype(np.int64) + 1)
    order = np.argsort(ranks[-1], kind="stable")
    shared = np.zeros(n, np.int64)
    if n > 1:
        a, b = order[:-1].copy(), order[1:].copy()
        for k in range(len(ranks) - 1, -1, -1):
            rank = np.append(ranks[k], 0)
            # A rank of 2**k words stands for that many words only if they are there.
            fits = (a + (1 << k) <= n) & (b + (1 << k) <= n)
            same = fits & (rank[np.minimum(a, n)] == rank[np.minimum(b, n)])
            step = same.astype(np.int64) << k
            a += step
            b += step
        shared[1:] = a - order[:-1]
    return order, shared


def maximal_pairs(ids: np.ndarray, shortest: int, keep: Callable[[int, int], bool]) -> Iterator[tuple[int, int, int]]:
    """``(start, distance, words)`` of maximal pairs of neighbouring occurrences of a stretch of at least ``shortest``
    words; ``keep`` is asked with distance and words."""
    order, shared = suffix_order(ids)
    before = np.concatenate(([-1], ids[:-1])).tolist()
    found: list[tuple[int, int, int]] = []

    def merge(one, other, length: int):
        """Two children of a node of ``length`` words, each a position or ``Places``; the merged list."""
        if isinstance(one, int) or (not isinstance(other, int) and one.size < other.size):
            one, other = other, one
        large = Places(one) if isinstance(one, int) else one
        small = [other] if isinstance(other, int) else list(other)
        own = set(small)
        for p, following in zip(small, [*small[1:], len(ids)], strict=True):
            a, b = large.add(p)
            # Neighbours from the same child share more words and were met below.
            if a >= 0 and a not in own and before[a] != before[p] and keep(p - a, length):
                found.append((a, p - a, length))
            if 0 <= b < following and before[b] != before[p] and keep(b - p, length):
                found.append((p, b - p, length))
        return large

    nodes: list[tuple[int, int | Places]] = []
    now: int | Places = -1
    for p, length in zip(order.tolist(), shared.tolist(), strict=True):
        # ``now`` is complete; close what is deeper than the common length with the next suffix.
        while nodes and nodes[-1][0] > length:
            depth, open_list = nodes.pop()
            now = merge(open_list, now, depth)
        if length >= shortest:
            if nodes and nodes[-1][0] == length:
                now = merge(nodes.pop()[1], now, length)
            nodes.append((length, now))
        now = p
    while nodes:
        depth, open_list = nodes.pop()
        now = merge(open_list, now, depth)
    yield from found


def shortest_pair(least: int, times: int) -> int:
    """The fewest words of a maximal pair that is a run: the larger of least - q and (times - 1) q at its smallest."""
    return -(-least * (times - 1) // times)


def find_runs(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs, by start, then period."""
    pairs = maximal_pairs(ids, shortest_pair(least, times), lambda q, n: q * (times - 1) <= n and q + n >= least)
    return sorted((start, n + q, q) for start, q, n in set(pairs))


def _may_repeat(ids: np.ndarray, row: np.ndarray, rows: int, size: int) -> np.ndarray:
    """Which rows hold some stretch of ``size`` words twice, or nearly so: stretches are compared by hash."""
    out = np.zeros(rows, bool)
    if len(ids) < size:
        return out
    h, width = words.mix(ids.astype(np.uint64) + np.uint64(1)), 1
    while width < size:
        step = min(width, size - width)
        h = words.mix(h[: len(h) - step] * np.uint64(0x9E3779B97F4A7C15) + h[step:])
        width += step
    inside = row[: len(h)] == row[len(row) - len(h) :]
    r, h = row[: len(h)][inside], h[inside]
    key = np.sort(words.mix(h + r.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)))
    twice = key[1:][key[1:] == key[:-1]]
    if len(twice):
        mine = words.mix(h + r.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        out[r[np.isin(mine, twice)]] = True
    return out


class Reader:
    """Numbers the words of texts exactly, as long as a group of texts is worked on."""

    def __init__(self, least: int, times: int, change: Callable | None):
        self.least, self.times, self.change = least, times, change

    def groups(self, ids: list, texts: list) -> Iterator[list[list[str]]]:
        held, size = [], 0
        for doc, text in zip(ids, texts, strict=True):
            found = WORD.findall(text or "")
            held.append(self.change(doc, found) if self.change else found)
            size += len(found)
            if size >= TOGETHER:
                yield held
                held, size = [], 0
        if held:
            yield held

    def __call__(self, ids: list, texts: list) -> Iterator[tuple[list[str], list[tuple[int, int, int]]]]:
        """Words and runs of every text, in order."""
        for group in self.groups(ids, texts):
            known: dict[str, int] = {}
            numbers = [known.setdefault(w, len(known)) for found in group for w in found]
            numbers, sizes = np.array(numbers, np.int64), np.array([len(f) for f in group])
            ends = np.cumsum(sizes)
            may = _may_repeat(numbers, np.repeat(np.arange(len(group)), sizes), len(group), shortest_pair(self.least, self.times))
            for k, found in enumerate(group):
                yield found, (find_runs(numbers[ends[k] - sizes[k] : ends[k]], self.least, self.times) if may[k] else [])


def collapsed(found: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words but those behind the first period of some run, joined by a space."""
    if not runs:
        return " ".join(found)
    drop = np.zeros(len(found) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    gone = np.cumsum(drop)[:-1] > 0
    return " ".join(w for w, g in zip(found, gone.tolist(), strict=True) if not g)


def _through(docs: DataFrame, id_col: str, text_col: str, least: int, times: int, change: Callable | None, make: Callable, schema: list[T.StructField]) -> DataFrame:
    """One row per row: the id as it is, and what ``make`` gives for its words and runs."""
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    types = T.StructType([T.StructField("id", plain.schema["id"].dataType), *schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = [f.type for f in to_arrow_schema(types)]
        read = Reader(least, times, change)
        for batch in batches:
            rows = [make(found, runs) for found, runs in read(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
            arrays = [batch.column(0)] + [pa.array(c, kind) for c, kind in zip(columns, kinds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=types.names)

    return plain.mapInArrow(run, types).withColumnRenamed("id", id_col)


RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def collapse(docs: DataFrame, least: int = LEAST, times: int = TIMES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``runs`` (start, length, period; by start, then period; words numbered from 0)
    and ``collapsed``, the words with each run cut to its first period, joined by a space.

    Words are runs of anything but ASCII white space.  Null and empty texts: no runs, an empty text.  Texts of any
    length are worked on whole, in memory in proportion to their words.  Repeated rows and rows without id
    are rows like any other.  Runs with equal start are ordered by period.  Empty table: no rows.  Other columns are
    ignored, whatever their names.
    """
    make = lambda found, runs: ([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], collapsed(found, runs))
    return _through(docs, id_col, text_col, least, times, None, make, [T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])


def planted(doc, found: list[str]) -> list[str]:
    """The registered query's words: of one id in ten the end of the text repeats a stretch of it.  No id: as they are."""
    h = zlib.crc32(str(doc).encode())
    if doc is None or h % 10 or not found:
        return found
    n, g = len(found), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    times = -(-(n - a) // p)
    return found[:a] + (found[a : a + p] * times)[: n - a]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with most periods, exactly; of equal ones the first, then the one with the smallest period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def _summary(found: list[str], runs: list[tuple[int, int, int]]) -> tuple:
    best = strongest(runs)
    start, length, period = best or (None, None, None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    milli = 1000 * length // period if best else None
    return len(runs), start, length, period, milli, *(hashlib.sha256(t.encode()).hexdigest() for t in (listed, collapsed(found, runs)))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the registered query: number of runs, the one with most periods, hashes of the list of runs and
    of the collapsed text, over texts some of which end in a planted repetition."""
    longs = [T.StructField(c, T.LongType()) for c in ("n_runs", "start", "length", "period", "exponent_milli")]
    hashes = [T.StructField(c, T.StringType()) for c in ("runs_sha256", "collapsed_sha256")]
    return _through(docs, id_col, text_col, LEAST, TIMES, planted, _summary, longs + hashes)
