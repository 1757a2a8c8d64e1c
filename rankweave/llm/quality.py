"""Quality classifier: a linear support vector machine on n-gram indicators scaled by naive Bayes ratios.

Indicators of a text, hashed to 2^18 places: words and word pairs, and runs of one to three word shapes.  The
shape of a word has its case, digits, marks, last mark and whether it repeats the word before.

1. One visit to the texts counts, over all labelled rows that may be learnt from, in how many texts of either
   class each indicator occurs, and picks the indicators of a bounded sample: at most ``sample`` rows of each
   label, those with the smallest hashes of the id.
2. r = log of the ratio of the smoothed class distributions.  The machine is fitted on the sample with x = r on
   the indicators present, by dual coordinate descent on the hinge loss, on three quarters of the sample; the
   last quarter gives the logistic curve that turns a margin into a score.
3. A second visit scores every text.

Labels are looked up in a mapped array, so texts are not shuffled.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm import hashstore as hs
from rankweave.llm import labelled as lb
from rankweave.llm import text as words
from rankweave.operators.numbering import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 18
SAMPLE = 3000


def _shapes(found: words.Words) -> np.ndarray:
    """A small number per word for its look."""
    data, start, end = found.data, found.start, found.end
    if not len(start):
        return np.zeros(0, np.uint64)
    table = np.zeros((4, 256), np.int32)
    table[0, 65:91] = 1
    table[1, 97:123] = 1
    table[2, 48:58] = 1
    table[3, :128] = [not chr(b).isalnum() for b in range(128)]
    counts = []
    for t in table:
        sums = np.concatenate(([0], np.cumsum(t[data])))
        counts.append(sums[end] - sums[start])
    upper, lower, digit, mark = counts
    case = np.where((upper > 1) & (lower == 0), 3, np.where(upper > 1, 2, upper))
    last = data[end - 1].astype(np.int64)
    last = np.where(table[3][last] == 1, last, 0)
    again = np.zeros(len(start), np.int64)
    again[1:] = (found.hashes[1:] == found.hashes[:-1]) & (found.row[1:] == found.row[:-1])
    code = ((case * 3 + np.minimum(digit, 2)) * 4 + np.minimum(mark, 3)) * 128 + last
    return (code * 2 + again).astype(np.uint64)


def indicators(found: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """``(row, place)`` of the indicators present, each once, by row."""
    h, row, shape = found.hashes, found.row, _shapes(found)
    rows, codes = [row, row], [words.mix(h + np.uint64(1)), words.mix(shape + np.uint64(1 << 40))]
    run = words.mix(shape + np.uint64(1 << 41))
    for n in (1, 2):
        same = row[n:] == row[:-n] if len(row) > n else np.zeros(0, bool)
        if n == 1:
            rows.append(row[1:][same])
            codes.append(words.mix(words.mix(h[:-1][same] + np.uint64(2)) + h[1:][same]))
        run = words.mix(run[: len(same)] * np.uint64(31) + shape[n:])
        rows.append(row[n:][same])
        codes.append(run[same])
    place = (np.concatenate(codes) >> np.uint64(64 - BITS)).astype(np.int64)
    both = words.distinct(np.concatenate(rows).astype(np.int64) << BITS | place)
    return both >> BITS, both & ((1 << BITS) - 1)


def _sliced(batches: Iterator[pa.RecordBatch], column: int):
    hasher = words.Hasher()
    for batch in batches:
        data, offsets = words.raw(batch.column(column))
        for i, j in words.slices(offsets):
            yield batch.slice(i, j - i), hasher.words(data, offsets[i : j + 1])


_SEEN = "piece int, data binary, label int"


def _visit(folder: str, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, counts = hs.Store(folder, shards, lb.LABEL), np.zeros((2, 1 << BITS), np.int64)
        texts = np.zeros(2, np.int64)

        def out(rows):
            cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
            kinds = (pa.int32(), pa.binary(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["piece", "data", "label"])

        for batch, found in _sliced(batches, 1):
            label = lb.look_up(store, batch.column(0))
            if (label < 0).all():
                continue
            row, place = indicators(found)
            for y in (0, 1):
                texts[y] += (label % 2 == y)[label >= 0].sum()
                counts[y] += np.bincount(place[(label >= 0)[row] & (label % 2 == y)[row]], minlength=1 << BITS)
            ends = np.searchsorted(row, np.arange(len(label) + 1))
            yield out([(-1, place[ends[k] : ends[k + 1]].astype("<i4").tobytes(), int(label[k]) - 2) for k in np.flatnonzero(label >= 2)])
        if texts.any():
            yield out([(p, data, None) for p, data in lb.dense_rows(counts)])

    return run


def ratios(counts: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    p, q = counts[1] + alpha, counts[0] + alpha
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_descent(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, c: float, rounds: int = 12) -> np.ndarray:
    """Weights (the last is the bias) of min |w|^2 / 2 + c sum max(0, 1 - y w.x), x = r on the places of a row."""
    w, alpha, order = np.zeros(len(r) + 1), np.zeros(len(rows)), np.random.default_rng(7)
    square = np.array([1.0 + (r[k] ** 2).sum() for k in rows])
    for _ in range(rounds):
        most = 0.0
        for j in order.permutation(len(rows)):
            k = rows[j]
            grad = y[j] * ((w[k] * r[k]).sum() + w[-1]) - 1
            new = min(max(alpha[j] - grad / square[j], 0.0), c)
            step = (new - alpha[j]) * y[j]
            if step:
                w[k] += step * r[k]
                w[-1] += step
                alpha[j] = new
                most = max(most, abs(step))
        if most < 1e-6:
            break
    return w


def _fitted(r: np.ndarray, share: tuple[float, float], c: float):
    """One task: the sample is bounded.  Returns weights of the places, bias, slope and shift."""

    def run(_: tuple, sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values(["label", "data"]).reset_index(drop=True)
        rows = [np.frombuffer(d, "<i4") for d in sample["data"]]
        y = sample["label"].to_numpy(np.int64)
        test = np.arange(len(rows)) % 4 == 3
        fit = np.flatnonzero(~test)
        w = dual_descent([rows[k] for k in fit], 2 * y[fit] - 1, r, c)
        full = np.append(w[:-1] * r, w[-1])
        margin = np.array([full[k].sum() + full[-1] for k in rows])
        use = test if len(set(y[test])) == 2 else np.ones(len(rows), bool)
        weight = np.where(y == 1, share[1] / max(1, (y[use] == 1).sum()), share[0] / max(1, (y[use] == 0).sum())) * use.sum()
        a, b = lb.calibrate(margin[use], y[use], weight[use])
        return pd.DataFrame({"weights": [np.append(full, (a, b)).astype("<f4").tobytes()]})

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str, kept: Column, id_col: str = "doc_id", text_col: str = "text",
        sample: int = SAMPLE, c: float = 0.01) -> np.ndarray:
    """Weights of the places, bias, slope and shift.  Without labels of both classes all are 0."""
    (folder, shards), _ = lb.store_labels(labels, id_col, label, kept, sample)
    rows = docs.select(F.xxhash64(F.col(id_col).cast("bigint")).alias("key"), F.col(text_col).cast("string").alias("text"))
    seen = durable(rows.mapInArrow(_visit(folder, shards), _SEEN), "indicators")
    counts = lb.dense_sum(seen.filter("label is null").select("piece", "data"), 2, 1 << BITS)
    texts = {r["label"]: r["n"] for r in seen.filter("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    empty = np.zeros((1 << BITS) + 3)
    if set(texts) != {0, 1}:
        empty[-1] = 0.0 if not texts else (4.0 if 1 in texts else -4.0)
        return empty
    # The sample has about as many rows of either label; the curve is fitted for the shares of all rows.
    total = labels.filter(kept & F.col(label).isin(0, 1)).groupBy(label).agg(F.countDistinct(id_col).alias("n")).collect()
    share = {r[label]: r["n"] for r in total}
    share = (share.get(0, 1) / sum(share.values()), share.get(1, 1) / sum(share.values()))
    chosen = seen.filter("label is not null").select("data", "label", F.lit(0).alias("one"))
    found = chosen.groupBy("one").applyInPandas(_fitted(ratios(counts), share, c), "weights binary").first()
    return np.frombuffer(bytes(found["weights"]), "<f4").astype(float)


def _score(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _sliced(batches, 1):
            row, place = indicators(found)
            margin = np.bincount(row, weights[place], batch.num_rows) + weights[-3]
            p = lb.sigmoid(weights[-2] * margin + weights[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["id", "score", "predicted"])

    return run


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_score(weights), f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def score_corpus(docs: DataFrame, labels: DataFrame, label: str = "quality", every: int = 3, rest: int = 1,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the id, held_out, score (0 to 1) and predicted, learnt from the rows not held out.

    Null and empty texts have no indicators and get the score of the bias alone.  Repeated rows give repeated
    rows, equal texts equal scores.  Without labels the score is 0.5; with labels of one class it leans to it.
    Empty table: no rows.  Other columns are ignored.
    """
    weights = fit(docs, labels, label, ~lb.held_out(id_col, every, rest), id_col, text_col)
    return score(docs, weights, id_col, text_col).select(id_col, lb.held_out(id_col, every, rest).alias("held_out"), "score", "predicted")
