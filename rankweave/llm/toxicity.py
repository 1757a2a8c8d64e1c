"""Toxic spans by a linear-chain conditional random field, summed up to a score per document.

Tokens are runs of letters and digits.  Features of a token, hashed to 2^18 places: the word, its first four to
eight and its last three bytes, and the words before and after it.

1. Evidence.  One visit to the labelled texts that may be learnt from counts for every word and word beginning
   in how many toxic and other texts it occurs, in 2^20 hashed places.
2. Labelled tokens.  In a toxic text, the words and beginnings seen nearly only in toxic texts (90 %, five texts
   or more) explain the label; the tokens with at least a quarter of the support of the strongest are marked
   toxic, all others clean.  A second visit emits such texts for a bounded sample: at most ``sample`` rows of
   either label, those with the smallest hashes of the id.
3. The field (two states, line-by-line chains of at most 64 tokens) is fitted by full-batch gradient steps on
   the forward-backward expectations over the sample; every fourth text is left out to fit the logistic curve
   from token marginals to the score.
4. A last visit tags all texts: marginals, spans of tokens with a marginal of one half or more, score.
"""

from __future__ import annotations

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
from rankweave.llm import labelled as lb
from rankweave.llm import text as words
from rankweave.llm.columns import bounded_batches, through_arrow
from rankweave.operators.numbering import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 18
EVIDENCE_BITS = 20
SAMPLE = 1200
CHAIN = 64
_STARTS = (4, 5, 6, 7, 8)
KINDS = 4 + len(_STARTS)


class Tokens:
    """Tokens of a slice of rows, with the hashes of their words, beginnings and ends, and their chains."""

    def __init__(self, hasher: words.Hasher, data: np.ndarray, offsets: np.ndarray):
        found = hasher.words(data, offsets)
        self.row, self.start, self.end, self.data = found.row, found.start, found.end, found.data
        self.rows = len(offsets) - 1
        self.word = found.hashes
        part = lambda a, b: hasher._ranges(found.data, a, b)
        self.heads = [part(found.start, np.minimum(found.end, found.start + n)) for n in _STARTS]
        self.tail = part(np.maximum(found.start, found.end - 3), found.end)
        lines = np.concatenate(([0], np.cumsum(found.data == 10)))[found.start] if len(found) else found.row
        new = np.ones(len(found), bool)
        new[1:] = (found.row[1:] != found.row[:-1]) | (lines[1:] != lines[:-1])
        begin = np.maximum.accumulate(np.where(new, np.arange(len(found)), 0)) if len(found) else np.zeros(0, np.int64)
        self.place = (np.arange(len(found)) - begin) % CHAIN
        self.chain = np.cumsum(self.place == 0) - 1

    def features(self) -> list[np.ndarray]:
        """Places by kind of feature."""
        before, after = np.roll(self.word, 1), np.roll(self.word, -1)
        first = self.place == 0
        before[first] = 1
        after[np.roll(first, -1)] = 2
        kinds = [self.word, *self.heads, self.tail, before, after]
        return [(words.mix(k + np.uint64(j + 1)) >> np.uint64(64 - BITS)).astype(np.int32) for j, k in enumerate(kinds)]

    def evidence(self) -> np.ndarray:
        """Places of the word and its beginnings, a row per token."""
        kinds = [self.word, *self.heads]
        return np.stack([(words.mix(k + np.uint64(j + 11)) >> np.uint64(64 - EVIDENCE_BITS)).astype(np.int64) for j, k in enumerate(kinds)], 1)


def marginals(score: np.ndarray, chain: np.ndarray, place: np.ndarray, move: np.ndarray):
    """``P(toxic)`` of every token and the expected moves (2 x 2), with the log of the chains' sums.

    ``score`` is the advantage of the toxic state.  All chains advance together, one place at a time.
    """
    n = int(chain[-1]) + 1 if len(chain) else 0
    if not n:
        return np.zeros(0), np.zeros((2, 2)), 0.0
    length = np.bincount(chain, minlength=n)
    order = np.argsort(-length, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    longest = int(length.max())
    at = np.full((longest, n), -1, np.int64)
    at[place, rank[chain]] = np.arange(len(chain))
    alive = (at >= 0).sum(1)
    trans = np.exp(move)
    up = np.exp(np.clip(score, -30, 30))
    alpha, scale = np.zeros((len(chain), 2)), np.zeros(len(chain))
    now = np.ones((n, 2))
    for t in range(longest):
        k = at[t, : alive[t]]
        now = now[: alive[t]] if t == 0 else now[: alive[t]] @ trans
        now = now * np.stack([np.ones(len(k)), up[k]], 1)
        total = now.sum(1, keepdims=True)
        now = now / total
        alpha[k], scale[k] = now, np.log(total[:, 0])
    post, moves = np.zeros(len(chain)), np.zeros((2, 2))
    back = np.ones((0, 2))
    for t in range(longest - 1, -1, -1):
        k = at[t, : alive[t]]
        full = np.ones((len(k), 2))
        if t + 1 < longest:
            j = at[t + 1, : alive[t + 1]]
            ahead = back * np.stack([np.ones(len(j)), up[j]], 1)
            a = alpha[k[: len(j)]]
            joint = a[:, :, None] * trans[None] * ahead[:, None, :]
            moves += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            beta = ahead @ trans.T
            full[: len(j)] = beta / beta.sum(1, keepdims=True) * 2
        both = alpha[k] * full
        post[k] = both[:, 1] / both.sum(1)
        back = full
    return post, moves, float(scale.sum())


@dataclass
class Model:
    weights: np.ndarray
    move: np.ndarray
    slope: float
    shift: float


def summary(post: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """One number per text: log odds of the surest token, more for further ones."""
    p = np.clip(post, 1e-6, 1 - 1e-6)
    most = np.full(rows, 1e-6)
    np.maximum.at(most, row, p)
    many = np.bincount(row, np.where(post >= 0.5, post, 0), rows)
    return np.log(most / (1 - most)) + np.log1p(many)


def _sliced(batches: Iterator[pa.RecordBatch], column: int, only=None):
    hasher = words.Hasher(marks=True)
    for batch in batches:
        if only is not None:
            batch = batch.filter(pa.array(only(batch)))
        data, offsets = words.raw(batch.column(column))
        for i, j in words.slices(offsets):
            yield batch.slice(i, j - i), Tokens(hasher, data, offsets[i : j + 1])


def _count(folder: str, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, counts = hs.Store(folder, shards, lb.LABEL), np.zeros((2, 1 << EVIDENCE_BITS), np.int64)
        for batch, tokens in _sliced(batches, 1, lambda b: lb.look_up(store, b.column(0)) >= 0):
            label, found = lb.look_up(store, batch.column(0)) % 2, tokens.evidence()
            pairs = words.distinct((np.repeat(tokens.row[:, None], found.shape[1], 1).astype(np.int64) << EVIDENCE_BITS | found).ravel())
            row, place = pairs >> EVIDENCE_BITS, pairs & ((1 << EVIDENCE_BITS) - 1)
            for y in (0, 1):
                counts[y] += np.bincount(place[label[row] == y], minlength=1 << EVIDENCE_BITS)
        rows = list(lb.dense_rows(counts))
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], names=["piece", "data"]
        )

    return run


def support(counts: np.ndarray) -> np.ndarray:
    """Toxic texts with the place, 0 unless it is seen in five or more of them and hardly in others."""
    a, b = counts[1], counts[0]
    return np.where((a >= 5) & (a >= 0.9 * (a + b)), a, 0).astype(np.int32)


_LABELLED = "data binary, label int"


def _label(folder: str, shards: int, strong: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = hs.Store(folder, shards, lb.LABEL)
        codec = pa.Codec("zstd")
        for batch, tokens in _sliced(batches, 1, lambda b: lb.look_up(store, b.column(0)) >= 2):
            label = lb.look_up(store, batch.column(0)) - 2
            held = strong[tokens.evidence()].max(1) if len(tokens.row) else np.zeros(0)
            best = np.zeros(tokens.rows)
            np.maximum.at(best, tokens.row, held)
            toxic = (held > 0) & (held >= best[tokens.row] / 4) & (label[tokens.row] == 1)
            table = np.stack([*tokens.features(), tokens.place, toxic], 1).astype("<i4")
            ends = np.searchsorted(tokens.row, np.arange(tokens.rows + 1))
            data = [codec.compress(table[a:b].tobytes(), asbytes=True) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            sizes = [int(b - a).to_bytes(8, "little") for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([s + d for s, d in zip(sizes, data, strict=True)], pa.binary()), pa.array(label.astype(np.int32))], names=["data", "label"]
            )

    return run


def _unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.Codec("zstd").decompress(data[8:], n * (KINDS + 2) * 4, asbytes=True), "<i4").reshape(n, KINDS + 2)


def _gain(w: np.ndarray, kinds) -> np.ndarray:
    """The advantage of the toxic state for every token, from its places by kind."""
    out = np.full(len(kinds[0]), w[-1])
    for k in kinds:
        out += w[k]
    return out


def train(features: np.ndarray, chain: np.ndarray, place: np.ndarray, toxic: np.ndarray, rounds: int = 60, keep: float = 3e-5):
    """Weights of the places (the last is the bias) and moves that maximise the regularised likelihood."""
    size = (1 << BITS) + 1
    w, move = np.zeros(size), np.zeros((2, 2))
    w[-1] = np.log((toxic.sum() + 1) / (len(toxic) - toxic.sum() + 1))
    follow = np.flatnonzero(place[1:] > 0)
    gold = np.zeros((2, 2))
    np.add.at(gold, (toxic[follow], toxic[follow + 1]), 1)
    kinds, n = [np.ascontiguousarray(k) for k in features.T], max(1.0, float(toxic.sum()))
    momentum, square = [np.zeros(size), np.zeros((2, 2))], [np.zeros(size), np.zeros((2, 2))]
    for turn in range(1, rounds + 1):
        post, moves, _ = marginals(_gain(w, kinds), chain, place, move)
        miss = toxic - post
        grad = np.zeros(size)
        for k in kinds:
            grad[:-1] += np.bincount(k, miss, size - 1)
        grad[-1] = miss.sum()
        for value, g, m, s in ((w, grad / n - keep * w, momentum[0], square[0]), (move, (gold - moves) / n - keep * move, momentum[1], square[1])):
            m *= 0.9
            m += 0.1 * g
            s *= 0.99
            s += 0.01 * g * g
            value += 0.1 * (m / (1 - 0.9**turn)) / (np.sqrt(s / (1 - 0.99**turn)) + 1e-4)
    return w, move


def _fitted(share: tuple[float, float]):
    """One task: the sample is bounded."""

    def run(_: tuple, sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values(["label", "data"]).reset_index(drop=True)
        tables = [_unpack(d) for d in sample["data"]]
        y = sample["label"].to_numpy(np.int64)
        test = np.arange(len(y)) % 4 == 3
        if len(set(y[test])) < 2 or len(set(y[~test])) < 2:
            test[:] = True
            fit = range(len(y))
        else:
            fit = np.flatnonzero(~test)
        both = np.concatenate([tables[k] for k in fit])
        chain = np.cumsum(both[:, KINDS] == 0) - 1
        w, move = train(both[:, :KINDS], chain, both[:, KINDS], both[:, KINDS + 1])
        rows = np.concatenate([np.full(len(tables[k]), j) for j, k in enumerate(np.flatnonzero(test))]).astype(np.int64)
        left = np.concatenate([tables[k] for k in np.flatnonzero(test)])
        post, _, _ = marginals(_gain(w, left[:, :KINDS].T), np.cumsum(left[:, KINDS] == 0) - 1, left[:, KINDS], move)
        z, seen = summary(post, rows, int(test.sum())), y[test]
        weight = np.where(seen == 1, share[1] / max(1, (seen == 1).sum()), share[0] / max(1, (seen == 0).sum())) * len(seen)
        a, b = lb.calibrate(z, seen, weight)
        return pd.DataFrame({"model": [np.concatenate([w, move.ravel(), [a, b]]).astype("<f4").tobytes()]})

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str, kept: Column, id_col: str = "doc_id", text_col: str = "text",
        sample: int = SAMPLE) -> Model:
    bounded_batches(docs.sparkSession)
    (folder, shards), _ = lb.store_labels(labels, id_col, label, kept, sample)
    rows = docs.select(F.xxhash64(F.col(id_col).cast("bigint")).alias("key"), F.col(text_col).cast("string").alias("text"))
    counts = lb.dense_sum(rows.mapInArrow(_count(folder, shards), "piece int, data binary"), 2, 1 << EVIDENCE_BITS)
    good = labels.filter(kept & F.col(label).isin(0, 1)).groupBy(label).agg(F.countDistinct(id_col).alias("n"))
    share = {r[label]: r["n"] for r in good.collect()}
    empty = Model(np.zeros((1 << BITS) + 1), np.zeros((2, 2)), 0.0, 0.0)
    chosen = durable(rows.mapInArrow(_label(folder, shards, support(counts)), _LABELLED), "tokens")
    if len(share) < 2 or chosen.select("label").distinct().count() < 2:
        empty.shift = -4.0 if 0 in share else (4.0 if 1 in share else -1e-3)
        return empty
    total = sum(share.values())
    one = chosen.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(_fitted((share[0] / total, share[1] / total)), "model binary").first()
    v = np.frombuffer(bytes(one["model"]), "<f4").astype(float)
    return Model(v[:-6], v[-6:-2].reshape(2, 2), v[-2], v[-1])


_TAGGED = "score double, predicted int, spans string"


def _tag(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.weights
        for batch, tokens in _sliced(batches, 1):
            gain = _gain(w, tokens.features())
            post, _, _ = marginals(gain, tokens.chain, tokens.place, model.move)
            p = lb.sigmoid(model.slope * summary(post, tokens.row, tokens.rows) + model.shift)
            spans = [""] * tokens.rows
            hit = np.flatnonzero(post >= 0.5)
            if len(hit):
                points = words.code_points(tokens.data)
                base = words.raw(batch.column(1))[1]
                base = points[base - base[0]]
                for r in np.unique(tokens.row[hit]):
                    mine = hit[tokens.row[hit] == r]
                    spans[r] = ",".join(f"{points[tokens.start[k]] - base[r]}:{points[tokens.end[k]] - base[r]}" for k in mine)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(spans, pa.string())], names=["id", "score", "predicted", "spans"]
            )

    return run


def _mild(model: Model, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.weights
        for batch, tokens in _sliced(batches, column):
            gain = _gain(w, tokens.features())
            post, _, _ = marginals(gain, tokens.chain, tokens.place, model.move)
            p = lb.sigmoid(model.slope * summary(post, tokens.row, tokens.rows) + model.shift)
            yield batch.filter(pa.array(p < 0.5))

    return run


def reject(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all columns."""
    return through_arrow(docs, _mild(model, docs.columns.index(text_col)))


def tag(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, score, predicted and ``spans``, the toxic tokens as ``start:end`` in code points."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_tag(model), f"id {kind}, {_TAGGED}").withColumnRenamed("id", id_col)


def score_corpus(docs: DataFrame, labels: DataFrame, label: str = "toxic", every: int = 5, rest: int = 0,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the id, held_out, score (0 to 1), predicted and spans, learnt from the rows not held out.

    Null and empty texts have no tokens and get the score of none.  Repeated rows give repeated rows, equal
    texts equal scores.  Without labels of both classes nothing is tagged and no document is predicted toxic,
    unless all labels are toxic.  Empty table: no rows.  Other columns are ignored.
    """
    model = fit(docs, labels, label, ~lb.held_out(id_col, every, rest), id_col, text_col)
    return tag(docs, model, id_col, text_col).select(id_col, lb.held_out(id_col, every, rest).alias("held_out"), "score", "predicted", "spans")
