"""Interpolated modified Kneser-Ney bigrams: counted in Spark, kept as sorted hash arrays, mapped by workers.

1. Words are hashed and counted; a shard of the vocabulary is one sorted file.  A word's number is its place
   over all shards.
2. A pair of word numbers is one 64-bit number, mixed by a bijection.  Tasks count the pairs of about two
   million words at a time and send sorted, squeezed arrays, cut by leading bits.  One task per shard merges
   them and writes the pair file.  From the pairs it gets, per word, in how many pairs the word comes second
   and how many pairs with count 1, 2 and more it begins; those sums are merged per shard of the vocabulary.
3. Workers map both stores and score whole texts with array look-ups.

Shards follow the bits of a hash, so a frequent word or source does not load one of them; their number follows
the amount of text.  A task holds one shard or two million words.  The driver gets sums and one row per shard.

p(w | u) = max(c(u,w) - D(c), 0) / c(u) + g(u) p(w);  p(w) = max(t(w) - D'(t), 0) / T + g' / (V + 1),
with t(w) the different words before w, T their sum, g the mass the discounts free.  A discount whose counts
of counts are not all positive is half its count.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm import hashstore as hs
from rankweave.llm import text as words
from rankweave.operators.numbering import durable, scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

END = np.uint64((1 << 64) - 1)
START = (1 << 32) - 2
# Words counted at once in a task, and bytes of text to a shard.
AT_ONCE = 1 << 21
SHARD_BYTES = 1 << 25
_WORD = {"count": "<u8"}
_FULL = {"count": "<u8", "n1": "<u4", "n2": "<u4", "n3": "<u4", "before": "<u4"}
_PAIR = {"count": "<u4"}


@dataclass
class Model:
    """Everything the workers need: where the files lie, and sums."""

    words: str
    pairs: str
    shards: int
    first: list[int]
    tokens: int
    vocabulary: int
    start: tuple[int, int, int, int]
    pair_discounts: list[float]
    word_discounts: list[float]
    types: int
    spare: float


def discounts(n: list[int]) -> list[float]:
    """D1, D2, D3+ from the numbers of items seen 1, 2, 3 and 4 times."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    out = []
    for c in (1, 2, 3):
        d = c - (c + 1) * y * n[c] / n[c - 1] if n[c - 1] and n[c] else c / 2
        out.append(min(max(d, 0.0), float(c)))
    return out


class Tokens:
    """The tokens of a slice of rows: words and one end for each row."""

    def __init__(self, hasher, data, offsets):
        found = hasher.words(data, offsets)
        rows = len(offsets) - 1
        each = np.bincount(found.row, minlength=rows)
        self.row = np.repeat(np.arange(rows), each + 1)
        self.hashes = np.full(len(found) + rows, END)
        self.hashes[np.arange(len(found)) + found.row] = found.hashes
        self.begins = np.cumsum(each + 1) - (each + 1)


def _sliced(batches: Iterator[pa.RecordBatch], column: int):
    hasher = words.Hasher()
    for batch in batches:
        data, offsets = words.raw(batch.column(column))
        for i, j in words.slices(offsets):
            yield batch, i, j, Tokens(hasher, data, offsets[i : j + 1])


def _send(keys: np.ndarray, counts: np.ndarray, shards: int) -> pa.RecordBatch:
    ends = np.searchsorted(hs.shard_of(keys, shards), np.arange(shards + 1))
    used = np.flatnonzero(np.diff(ends))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(used.astype(np.int32)),
            pa.array([hs.squeeze(keys[ends[s] : ends[s + 1]]) for s in used], pa.binary()),
            pa.array([hs.squeeze(np.cumsum(counts[ends[s] : ends[s + 1]], dtype=np.uint64)) for s in used], pa.binary()),
        ],
        names=["shard", "keys", "counts"],
    )


def _received(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    parts = []
    for keys, sums in zip(group["keys"], group["counts"], strict=True):
        parts.append((hs.unsqueeze(keys), np.diff(hs.unsqueeze(sums), prepend=np.uint64(0))))
    return hs.merge_counts(parts)


def _counting(keys_of, shards: int):
    """Count what ``keys_of`` finds in the texts; one squeezed array per shard and two million words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        find = keys_of()
        for _, _, _, tokens in _sliced(batches, 0):
            held.append(find(tokens))
            n += len(held[-1])
            if n >= AT_ONCE:
                yield _send(*np.unique(np.concatenate(held), return_counts=True), shards)
                held, n = [], 0
        if held:
            yield _send(*np.unique(np.concatenate(held), return_counts=True), shards)

    return run


def _numbers(store: hs.Store, first: np.ndarray, hashes: np.ndarray):
    """Number of each word (-1: unknown), the distinct words' values, and where each word is among them."""
    distinct, place = np.unique(hashes, return_inverse=True)
    found = store.find(distinct)
    number = np.where(found["index"] >= 0, first[hs.shard_of(distinct, store.shards)] + found["index"], -1)
    return number[place], found, place


def _pair_keys(folder: str, shards: int, first: list[int]):
    def make():
        store, at = hs.Store(folder, shards, _WORD), np.array(first, np.int64)

        def find(tokens: Tokens) -> np.ndarray:
            second, _, _ = _numbers(store, at, tokens.hashes)
            before = np.roll(second, 1)
            before[tokens.begins] = START
            return words.mix((before.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64))

        return find

    return make


def _word_shard(folder: str):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _received(group)
        hs.write_shard(folder, f"{int(key[0]):06d}", keys, {"count": counts.astype("<u8")})
        return pd.DataFrame({"shard": [int(key[0])], "n": [len(keys)], "total": [int(counts.sum())]})

    return run


_PAIR_OUT = "shard int, ids binary, stats binary, c1 bigint, c2 bigint, c3 bigint, c4 bigint, n bigint"


def _pair_shard(folder: str, first: list[int]):
    bounds = np.array([*first[1:], 1 << 32], np.int64)

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _received(group)
        hs.write_shard(folder, f"{int(key[0]):06d}", keys, {"count": counts.astype("<u4")})
        pairs = words.unmix(keys)
        left, right = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        ids, place = np.unique(np.concatenate((left, right)), return_inverse=True)
        u, w = place[: len(left)], place[len(left) :]
        stats = [np.bincount(u[counts == c], minlength=len(ids)) for c in (1, 2)]
        stats += [np.bincount(u[counts > 2], minlength=len(ids)), np.bincount(w, minlength=len(ids))]
        table = np.stack(stats).astype("<u4")
        # The start has no place in the vocabulary; the first shard takes it along.
        shard = np.searchsorted(bounds, ids, "right")
        shard[ids == START] = 0
        order = np.argsort(shard, kind="stable")
        ends = np.searchsorted(shard[order], np.arange(len(bounds) + 1))
        codec, rows = pa.Codec("zstd"), []
        for s in np.flatnonzero(np.diff(ends)):
            at = order[ends[s] : ends[s + 1]]
            rows.append((int(s), hs.squeeze(np.sort(ids[at]).astype("<u8")), codec.compress(
                np.ascontiguousarray(table[:, at[np.argsort(ids[at])]]).view(np.uint8).reshape(-1, 4).T.tobytes(), asbytes=True)))
        out = pd.DataFrame(rows, columns=["shard", "ids", "stats"])
        for c in (1, 2, 3, 4):
            out[f"c{c}"] = 0
        out["n"] = 0
        if len(out):
            out.loc[0, ["c1", "c2", "c3", "c4", "n"]] = [*(int((counts == c).sum()) for c in (1, 2, 3, 4)), len(keys)]
        return out

    return run


_WORD_OUT = (
    "c1 bigint, c2 bigint, c3 bigint, c4 bigint, c3plus bigint, types bigint, s1 bigint, s2 bigint, s3 bigint"
)


def _full_shard(vocabulary: str, folder: str, shards: int, first: list[int]):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        s = int(key[0])
        keys, values = hs.Store(vocabulary, shards, _WORD).shard(s)
        codec, total, start = pa.Codec("zstd"), np.zeros((4, len(keys)), np.int64), np.zeros(4, np.int64)
        for ids, stats in zip(group["ids"], group["stats"], strict=True):
            ids = hs.unsqueeze(ids).astype(np.int64)
            planes = np.frombuffer(codec.decompress(stats, 16 * len(ids), asbytes=True), np.uint8).reshape(4, -1)
            table = np.ascontiguousarray(planes.T).view("<u4").reshape(4, -1)
            if len(ids) and ids[-1] == START:
                start += table[:, -1]
                ids, table = ids[:-1], table[:, :-1]
            total[:, ids - first[s]] += table
        before = total[3]
        hs.write_shard(folder, f"{s:06d}", keys, {"count": np.asarray(values["count"])} | {
            name: total[j].astype("<u4") for j, name in enumerate(("n1", "n2", "n3", "before"))})
        seen = [int((before == c).sum()) for c in (1, 2, 3, 4)]
        row = [*seen, int((before > 2).sum()), int(before.sum()), *map(int, start[:3])]
        return pd.DataFrame([row], columns=[c.split()[0] for c in _WORD_OUT.split(", ")])

    return run


def number_words(texts: DataFrame) -> tuple[str, int, list[int], int, int]:
    """The vocabulary as a store with counts: folder, shards, number of the first word of each shard; tokens, words."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0]
    shards = 1 << max(0, math.ceil(math.log2(max(1, (size or 0) / SHARD_BYTES))))
    vocabulary = scratch(texts.sparkSession, "vocabulary")
    sent = "shard int, keys binary, counts binary"
    counted = texts.mapInArrow(_counting(lambda: lambda tokens: tokens.hashes, shards), sent)
    counted = _deal(counted, shards).applyInPandas(_word_shard(vocabulary), "shard int, n bigint, total bigint")
    got = {r["shard"]: r for r in counted.collect()}
    sizes = [got[s]["n"] if s in got else 0 for s in range(shards)]
    tokens, known = sum(r["total"] for r in got.values()), sum(sizes)
    if known >= START:
        raise ValueError("more than 2**32 different words")
    return vocabulary, shards, [0, *np.cumsum(sizes)[:-1].tolist()], tokens, known


def fit(texts: DataFrame) -> Model:
    """Fit on the one column of ``texts``.  Null counts as empty; an empty table gives a model without words."""
    spark = texts.sparkSession
    column = texts.columns[0]
    texts = texts.select(F.col(column).cast("string").alias("text"))
    rows = texts.count()
    vocabulary, shards, first, tokens, known = number_words(texts)
    full, pairs = (scratch(spark, name) for name in ("words", "pairs"))
    sent = "shard int, keys binary, counts binary"
    counted = texts.mapInArrow(_counting(_pair_keys(vocabulary, shards, first), shards), sent)
    merged = durable(_deal(counted, shards).applyInPandas(_pair_shard(pairs, first), _PAIR_OUT), "pairs")
    c = merged.agg(*[F.sum(x).alias(x) for x in ("c1", "c2", "c3", "c4")]).first()
    stats = _deal(merged.select("shard", "ids", "stats"), shards).applyInPandas(
        _full_shard(vocabulary, full, shards, first), _WORD_OUT
    )
    t = stats.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in stats.columns]).first()
    below = discounts([t["c1"], t["c2"], t["c3"], t["c4"]])
    freed = below[0] * t["c1"] + below[1] * t["c2"] + below[2] * t["c3plus"]
    return Model(
        full, pairs, shards, first, tokens, known, (rows, t["s1"], t["s2"], t["s3"]),
        discounts([c[x] or 0 for x in ("c1", "c2", "c3", "c4")]), below, t["types"],
        freed / t["types"] if t["types"] else 1.0,
    )


def _deal(df: DataFrame, shards: int):
    """One group per shard; as many partitions as shards, so that a task holds about one."""
    return df.repartition(max(shards, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "shard").groupBy("shard")


_SCORED = "n_tokens bigint, n_known bigint, base_score double, score double"


def _scoring(model: Model):
    m = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, pairs = hs.Store(m.words, m.shards, _FULL), hs.Store(m.pairs, m.shards, _PAIR)
        first = np.array(m.first, np.int64)
        d2, d1 = np.array([0.0, *m.pair_discounts]), np.array([0.0, *m.word_discounts])
        for batch, i, j, tokens in _sliced(batches, 1):
            second, found, place = _numbers(store, first, tokens.hashes)
            rows = j - i
            count = found["count"].astype(float)
            base = np.log10((count + 0.1) / (m.tokens + 0.1 * (m.vocabulary + 1)))
            before = found["before"].astype(float)
            lower = np.maximum(before - d1[np.minimum(found["before"], 3)], 0) / max(m.types, 1)
            lower += m.spare / (m.vocabulary + 1)
            free = d2[1] * found["n1"] + d2[2] * found["n2"] + d2[3] * found["n3"]
            # Of the word before each token: how often it was seen, and the mass its discounts free.
            seen, left = np.roll(count[place], 1), np.roll(free[place], 1)
            seen[tokens.begins] = m.start[0]
            left[tokens.begins] = d2[1] * m.start[1] + d2[2] * m.start[2] + d2[3] * m.start[3]
            prior = np.roll(second, 1)
            prior[tokens.begins] = START
            both = np.flatnonzero((second >= 0) & (prior >= 0))
            keys = words.mix((prior[both].astype(np.uint64) << np.uint64(32)) | second[both].astype(np.uint64))
            distinct, at = np.unique(keys, return_inverse=True)
            c = np.zeros(len(second))
            c[both] = pairs.find(distinct)["count"][at]
            p = lower[place]
            after = seen > 0
            p[after] = (np.maximum(c - d2[np.minimum(c, 3).astype(int)], 0)[after] + left[after] * p[after]) / seen[after]
            total = lambda v: np.bincount(tokens.row, v, rows)
            values = [
                np.bincount(tokens.row, minlength=rows),
                total((count[place] > 0).astype(float)).astype(np.int64),
                total(base[place]),
                total(np.log10(p)),
            ]
            keep = batch.slice(i, rows)
            yield pa.RecordBatch.from_arrays(
                [keep.column(0), *(pa.array(v) for v in values)],
                names=["id", "n_tokens", "n_known", "base_score", "score"],
            )

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_tokens (words and one end), n_known, base_score and score (log10 probabilities).

    Null and empty texts: the end alone.  Repeated rows and rows without id are scored like any other.  Other
    columns are ignored.  Perplexity: 10 ** (-score / n_tokens).
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_scoring(model), f"id {kind}, {_SCORED}")
    return out.withColumnRenamed("id", id_col)


def held_out(id_col: str, every: int = 10, rest: int = 0) -> Column:
    """Whether crc32 of the id as text leaves ``rest``; a row without id never does."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % every == rest, F.lit(False))


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 10) -> DataFrame:
    """Fit on the rows that are not held out and score all: the id, held_out, and what ``score`` returns."""
    model = fit(docs.filter(~held_out(id_col, every)).select(text_col))
    scored = score(docs, model, id_col, text_col)
    return scored.select(
        id_col,
        held_out(id_col, every).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
    )
