"""Benchmark passages in documents, found in a latent space and proven word by word.

A passage is two neighbouring blocks of 16 words.  Words are runs of letters and digits, hashed to 2^18 places.

1. One visit to the different texts counts in how many blocks each place occurs; that gives inverse block
   frequencies.  Words in more than a tenth of the blocks are common: they carry no weight, except in items with
   common words and fewer than four others.  Such plain items have groups of their own, in which all words, also
   those of the documents, weigh the same.
2. Benchmark passages are cut into groups of at most ``GROUP``; each group's TF-IDF matrix gets a truncated
   singular value decomposition by random projection and power iterations, one task per group.
3. Every document passage is projected into each space.  Its score with a benchmark passage is the cosine of
   the whole passage with the latent image of the other.  A passage whose projection is too short for any
   cosine of ``CANDIDATE`` needs no product; this bound drops no pair.
4. A candidate is compared with the whole benchmark item around the place: the longest common subsequence of
   the weighted words (of all words for a plain item), over the item's number of them.  0.7 proves it; from 0.5 on, a paraphrase counts if the
   item's answer (a column, or its last third) also stands there to 0.8.

The benchmark is a query set run in blocks against all passages; its matrices lie in the shared folder and are
mapped by the workers, so nothing is broadcast.  Only the count of different texts shuffles documents.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm import hashstore as hs
from rankweave.llm import labelled as lb
from rankweave.llm import text as words
from rankweave.llm.columns import through_arrow
from rankweave.operators.numbering import number_rows, scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 16
BITS = 18
RANK = 256
GROUP = 1024
COMMON = 0.1
CANDIDATE = 0.2
AT_ONCE = 1024
_NO_ITEM = -(1 << 63)
PROVEN, LIKELY, ANSWER = 0.7, 0.5, 0.8


class Passages:
    """Words of a slice of rows in blocks of 16; ``place``, ``block`` per word and ``row`` per block."""

    def __init__(self, hasher: words.Hasher, data: np.ndarray, offsets: np.ndarray):
        found = hasher.words(data, offsets)
        self.found, self.rows = found, len(offsets) - 1
        self.place = (words.mix(found.hashes) >> np.uint64(64 - BITS)).astype(np.int64)
        each = np.bincount(found.row, minlength=self.rows)
        self.first = np.concatenate(([0], np.cumsum(each)))
        blocks = -(-each // BLOCK)
        starts = np.concatenate(([0], np.cumsum(blocks)))
        within = np.arange(len(found)) - self.first[found.row]
        self.block = starts[found.row] + within // BLOCK
        self.row = np.repeat(np.arange(self.rows), blocks)
        # The passage that starts at a block takes the next one along, within its row; a last block of
        # several stands alone only where the row has one.
        last = starts[1:][self.row] - 1
        at = np.arange(len(self.row))
        self.alone = at == last
        self.starts = starts[:-1]

    def sums(self, block: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Sums of values that lie in blocks over passages, by first block."""
        one = np.bincount(block, value, len(self.row))
        two = np.append(one[1:], 0)
        return np.where(self.alone, one, one + two)


def _sliced(batches: Iterator[pa.RecordBatch], column: int):
    hasher = words.Hasher(marks=True)
    for batch in batches:
        data, offsets = words.raw(batch.column(column))
        for i, j in words.slices(offsets):
            yield batch.slice(i, j - i), Passages(hasher, data, offsets[i : j + 1])


def _frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((1, (1 << BITS) + lb.PIECE), np.int64)
    for _, p in _sliced(batches, 0):
        places = words.distinct(p.block << BITS | p.place) & ((1 << BITS) - 1)
        counts[0] += np.bincount(places, minlength=counts.shape[1])
        counts[0, 1 << BITS] += len(p.row)
    rows = list(lb.dense_rows(counts))
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], names=["piece", "data"])


def inverse_frequency(texts: DataFrame) -> np.ndarray:
    """Weight of every place; 0 for places in more than a tenth of the blocks.  Copies count once."""
    counts = lb.dense_sum(texts.distinct().mapInArrow(_frequency, "piece int, data binary"), 1, (1 << BITS) + lb.PIECE)[0]
    n, df = counts[1 << BITS], counts[: 1 << BITS]
    weight = np.log((n + 1) / (df + 1))
    return np.where(df > max(COMMON * n, 3), 0.0, weight).astype(np.float32)


_ITEM = "item bigint, passage int, places array<int>, all_places array<int>, answer int, plain boolean"


def _weights(weight: np.ndarray, group: int) -> np.ndarray:
    """The weights of a group; groups of plain items have odd numbers."""
    return np.ones_like(weight) if group % 2 else weight


def _items(weight: np.ndarray):
    """A row per passage of a benchmark item, with the weighted places of the passage and of the whole item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = words.Hasher(marks=True)
        for batch in batches:
            rows = []
            for item, text, answer in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data, offsets = words.raw(pa.array([text or ""]))
                p = Passages(hasher, data, offsets)
                whole = _weighted(p.place, weight)
                plain = bool((weight[whole] == 0).any())
                own_weight = _weights(weight, int(plain))
                tail = len(whole) - len(whole) // 3 if answer is None else _answer_start(hasher, answer, whole, own_weight)
                for b in range(len(p.row)):
                    own = p.place[(p.block == b) | ((p.block == b + 1) & ~p.alone[b])]
                    if not (p.alone[b] and b > 0):
                        rows.append((item, b, own[own_weight[own] > 0].tolist(), whole.tolist(), tail, plain))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                names=["item", "passage", "places", "all_places", "answer", "plain"],
            )

    return run


def _weighted(place: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The weighted words; all words where fewer than four have weight."""
    kept = place[weight[place] > 0]
    return kept if len(kept) >= 4 else place


def _answer_start(hasher: words.Hasher, answer: str, whole: np.ndarray, weight: np.ndarray) -> int:
    """Where the answer's words begin in the item, or its last third if they do not end it."""
    data, offsets = words.raw(pa.array([answer]))
    place = Passages(hasher, data, offsets).place
    kept = place[weight[place] > 0]
    n = len(kept)
    return len(whole) - n if 0 < n <= len(whole) and (whole[-n:] == kept).all() else len(whole) - len(whole) // 3


def random_svd(a: np.ndarray, rank: int, rounds: int = 3) -> np.ndarray:
    """Right singular vectors (columns) of the rows of ``a`` by random projection and power iterations."""
    rank = min(rank, *a.shape)
    draw = np.random.default_rng(11).standard_normal((a.shape[1], min(rank + 8, *a.shape))).astype(np.float32)
    q, _ = np.linalg.qr(a @ draw)
    for _ in range(rounds):
        z, _ = np.linalg.qr(a.T @ q)
        q, _ = np.linalg.qr(a @ z)
    _, _, vt = np.linalg.svd(q.T @ a, full_matrices=False)
    return np.ascontiguousarray(vt[:rank].T)


def _space(folder: str, weight: np.ndarray):
    """One group of benchmark passages: writes its places, word vectors, passage images and items."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        own_weight = _weights(weight, int(key[0]))
        group = group.sort_values(["item", "passage"], na_position="first").reset_index(drop=True)
        vocabulary = np.unique(np.concatenate([np.asarray(p, np.int64) for p in group["places"]] or [np.zeros(0, np.int64)]))
        if not len(vocabulary):
            return pd.DataFrame({"group": [int(key[0])], "rank": [0]})
        a = np.zeros((len(group), len(vocabulary)), np.float32)
        for k, p in enumerate(group["places"]):
            places = np.unique(np.asarray(p, np.int64))
            a[k, np.searchsorted(vocabulary, places)] = own_weight[places]
        a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-9)
        v = random_svd(a, RANK)
        image = a @ v
        image /= np.maximum(np.linalg.norm(image, axis=1, keepdims=True), 1e-9)
        name = f"{int(key[0]):06d}"
        vectors = v * own_weight[vocabulary][:, None]
        hs.write_shard(folder, f"{name}-words", vocabulary.astype(np.uint64), {"v": vectors.astype("<f4")})
        hs.write_shard(folder, f"{name}-images", np.arange(len(group), dtype=np.uint64), {"v": image.astype("<f4")})
        flat = np.concatenate([np.asarray(x, np.uint64) for x in group["all_places"]])
        ends = np.cumsum([len(x) for x in group["all_places"]])
        table = np.stack([group["item"].to_numpy(np.int64), ends, group["answer"].to_numpy(np.int64)], 1)
        hs.write_shard(folder, f"{name}-items", np.arange(len(group), dtype=np.uint64), {"v": table.astype("<i8")})
        hs.write_shard(folder, f"{name}-flat", flat, {})
        return pd.DataFrame({"group": [int(key[0])], "rank": [v.shape[1]]})

    return run


def common(item: list[int], other: list[int]) -> int:
    """Length of the longest common subsequence, a bit per word of ``item``."""
    at: dict[int, int] = {}
    for k, w in enumerate(item):
        at[w] = at.get(w, 0) | 1 << k
    full = (1 << len(item)) - 1
    row = full
    for w in other:
        hit = row & at.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


class Spaces:
    """The groups' matrices, mapped from the shared folder when first used."""

    def __init__(self, folder: str, groups: list[tuple[int, int]]):
        self.folder, self.groups, self.held = folder, groups, {}

    def _read(self, group: int, part: str, kind: str, width: int):
        data = hs.Store(self.folder, 1, {})._bytes(f"{group:06d}-{part}")
        n = int(data[:8].view("<u8")[0])
        return data[8 : 8 + 8 * n].view("<u8"), data[8 + 8 * n :].view(kind).reshape(n, width)

    def get(self, group: int, rank: int):
        """Row of each place (-1: unknown), word vectors, passage images, items."""
        if group not in self.held:
            places, vectors = self._read(group, "words", "<f4", rank)
            _, images = self._read(group, "images", "<f4", rank)
            _, table = self._read(group, "items", "<i8", 3)
            flat, _ = self._read(group, "flat", "<u8", 0)
            row = np.full(1 << BITS, -1, np.int32)
            row[places.astype(np.int64)] = np.arange(len(places))
            self.held[group] = (row, np.array(vectors), np.array(images), (table, flat))
        return self.held[group]

    def item(self, group: int, rank: int, passage: int) -> tuple[int, list[int], int]:
        """The item of a passage: its id, its words' places, and where its answer begins."""
        table, flat = self.get(group, rank)[3]
        number, end, tail = table[passage].tolist()
        return number, flat[table[passage - 1][1] if passage else 0 : end].astype(np.int64).tolist(), tail


def _candidates(p: Passages, weight: np.ndarray, spaces: Spaces):
    """``(first block, group, passage of the group, score)`` of the pairs with a score of CANDIDATE or more."""
    # A word counts once in a block, so that a repeated word does not make a passage look longer or nearer.
    pairs = words.distinct(p.block << BITS | p.place)
    measured = {}
    for group, rank in spaces.groups:
        if group % 2 not in measured:
            own_weight = _weights(weight, group)
            block, place = pairs >> BITS, pairs & ((1 << BITS) - 1)
            heavy = own_weight[place] > 0
            block, place = block[heavy], place[heavy]
            squares = own_weight[place].astype(float) ** 2
            measured[group % 2] = block, place, squares, np.sqrt(p.sums(block, squares))
        block, place, squares, norm = measured[group % 2]
        row, vectors, images, _ = spaces.get(group, rank)
        at = row[place]
        used = np.flatnonzero(at >= 0)
        # The share of a passage's weight that lies on known words bounds every cosine with this group.
        worth = (norm > 0) & (np.sqrt(p.sums(block[used], squares[used])) >= CANDIDATE * norm)
        first = np.flatnonzero(worth)
        for i in range(0, len(first), AT_ONCE):
            ids = first[i : i + AT_ONCE]
            blocks = np.unique(np.concatenate((ids, ids[~p.alone[ids]] + 1)))
            lo, hi = np.searchsorted(block[used], (blocks[0], blocks[-1] + 1))
            part = used[lo:hi]
            part = part[np.isin(block[part], blocks)]
            found, begin = np.unique(block[part], return_index=True)
            own = np.zeros((len(blocks) + 1, rank), np.float32)
            if len(part):
                own[np.searchsorted(blocks, found)] = np.add.reduceat(vectors[at[part]], begin, axis=0)
            follow = np.where(p.alone[ids], len(blocks), np.searchsorted(blocks, ids + 1))
            z = own[np.searchsorted(blocks, ids)] + own[follow]
            long = np.linalg.norm(z, axis=1) >= CANDIDATE * norm[ids]
            score = z[long] @ images.T / norm[ids[long]][:, None]
            x, y = np.nonzero(score >= CANDIDATE)
            yield from zip(ids[long][x].tolist(), [group] * len(x), y.tolist(), score[x, y].tolist(), strict=True)


_FOUND = "item_id bigint, score double, lcs double, answer double, start_word bigint"


def _found(p: Passages, spaces: Spaces, rank: dict[int, int], weight: np.ndarray) -> dict[tuple[int, int], tuple]:
    """``(row, item): (score, lcs, answer, first word of the passage)`` of the proven candidates of a slice."""
    best: dict[tuple[int, int], tuple] = {}
    for block, group, passage, score in _candidates(p, weight, spaces):
        item, whole, tail = spaces.item(group, rank[group], passage)
        r = int(p.row[block])
        known = best.get((r, item))
        if known and known[1] == 1.0:
            continue
        begin = int(p.first[r] + (block - p.starts[r]) * BLOCK)
        reach = 2 * len(whole)
        near = p.place[max(p.first[r], begin - reach) : min(p.first[r + 1], begin + 2 * BLOCK + reach)]
        if (weight[np.asarray(whole)] > 0).all():
            near = near[weight[near] > 0]
        long = len(whole) >= 8
        # The item's words that stand there at all bound the common subsequence.
        if np.isin(whole, near).sum() < (LIKELY if long else 0.9) * len(whole):
            continue
        near = near.tolist()
        lcs = common(whole, near) / len(whole)
        end = whole[tail:] or whole
        answer = common(end, near) / len(end)
        hit = lcs >= (PROVEN if long else 0.9) or (long and lcs >= LIKELY and answer >= ANSWER)
        if hit and (not known or (lcs, score) > (known[1], known[0])):
            best[r, item] = (score, lcs, answer, begin - int(p.first[r]))
    return best


def _search(folder: str, groups: list[tuple[int, int]], weight: np.ndarray):
    names = ["id", *[c.split()[0] for c in _FOUND.split(", ")]]
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaces = Spaces(folder, groups)
        for batch, p in _sliced(batches, 1):
            rows = [(*k, *v) for k, v in sorted(_found(p, spaces, dict(groups), weight).items())]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            cols = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(cols[0]), *cols[1:]], names=names)

    return run


def _clean(folder: str, groups: list[tuple[int, int]], weight: np.ndarray, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaces = Spaces(folder, groups)
        for batch, p in _sliced(batches, column):
            good = np.ones(batch.num_rows, bool)
            good[[r for r, _ in _found(p, spaces, dict(groups), weight)]] = False
            yield batch.filter(pa.array(good))

    return run


def _prepare(texts: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, answer_col: str | None):
    """Weights of the places, and the folder and ranks of the benchmark's spaces."""
    weight = inverse_frequency(texts)
    answer = F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")
    item = F.coalesce(F.col(item_col).cast("bigint"), F.lit(_NO_ITEM))
    source = benchmark.select(item.alias("item"), F.col(item_text_col).cast("string").alias("text"), answer.alias("answer"))
    passages = number_rows(source.mapInArrow(_items(weight), _ITEM), [F.asc("item"), F.asc("passage"), F.asc("all_places")], out="n")
    passages = passages.withColumn("group", (2 * F.floor(F.col("n") / GROUP) + F.col("plain").cast("int")).cast("int"))
    folder = scratch(texts.sparkSession, "spaces")
    spaces = passages.groupBy("group").applyInPandas(_space(folder, weight), "group int, rank int").collect()
    return weight, folder, sorted((r["group"], r["rank"]) for r in spaces if r["rank"])


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", answer_col: str | None = None) -> DataFrame:
    """One row per document and benchmark item found in it: the id, item_id, score (latent cosine of the best
    place), lcs, answer, start_word (of the passage, counted in words).

    Null and empty texts hold and match nothing; an item of fewer than eight words that count has to be found to
    0.9.  Repeated documents give repeated rows; repeated items one row per item id.  An empty table on either
    side gives no rows.  Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    weight, folder, groups = _prepare(rows.select("text"), benchmark, item_col, item_text_col, answer_col)
    out = rows.mapInArrow(_search(folder, groups, weight), f"id {kind}, {_FOUND}")
    return out.withColumn("item_id", F.nullif("item_id", F.lit(_NO_ITEM))).withColumnRenamed("id", id_col)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", answer_col: str | None = None) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item; all columns stay."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    weight, folder, groups = _prepare(texts, benchmark, item_col, item_text_col, answer_col)
    return through_arrow(docs, _clean(folder, groups, weight, docs.columns.index(text_col)))
