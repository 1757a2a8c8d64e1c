"""Interpolated modified Kneser-Ney model of any order; ``lm`` is the same for bigrams in less space.

An n-gram is the numbers of its words, four bytes each.  Texts begin with n - 1 start marks.  Tasks count the n-grams of
about two million words at a time; Spark adds them up.  Below the highest order the count of a gram is the number of
different words before it, which is one more grouping, by the gram's last words; the totals of contexts are
groupings by its first words.  So every order comes from the one above it, and no order needs the texts again.

    p_k(w | u) = (max(c(u w) - D_k(c), 0) + (D_k1 n1 + D_k2 n2 + D_k3 n3) p_k-1(w | u')) / c(u)

with u' = u without its first word, n1, n2, n3 the continuations of u with counts 1, 2 and more; p_0 = 1 / (V + 1).
A context that was never seen leaves p_k-1.  Counts and contexts are sorted arrays of 64-bit hashes of the grams.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm import hashstore as hs
from rankweave.llm import lm
from rankweave.llm import text as words
from rankweave.operators.numbering import drop, durable, scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

START = np.uint32(0xFFFFFFFE)
_COUNT, _CONTEXT = {"count": "<u4"}, {"total": "<u8", "n1": "<u4", "n2": "<u4", "n3": "<u4"}


@dataclass
class Model:
    """Where the stores lie and how many shards they have: words, counts and contexts by order from 1."""

    order: int
    words: tuple[str, int]
    first: list[int]
    tokens: int
    vocabulary: int
    counts: list[tuple[str, int]]
    contexts: list[tuple[str, int]]
    discounts: list[list[float]]


def discounts(seen: list[int]) -> list[float]:
    """As ``lm.discounts``; one that would free nothing is half its count, so that no word gets probability 0."""
    return [d or c / 2 for c, d in enumerate(lm.discounts(seen), 1)]


def _history(numbers: np.ndarray, begins: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at every token, a row each; -1 (unknown) becomes the largest number."""
    at = np.arange(len(numbers))
    place = at - np.repeat(begins, np.diff(np.append(begins, len(numbers))))
    columns = [np.where(place >= j, np.roll(numbers, j).astype(np.uint32), START) for j in range(order - 1, -1, -1)]
    return np.stack(columns, 1) if len(numbers) else np.zeros((0, order), np.uint32)


def _key(grams: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of numbers."""
    out = np.full(len(grams), grams.shape[1], np.uint64)
    for j in range(grams.shape[1]):
        out = words.mix(out * np.uint64(0x100000001B3) + grams[:, j].astype(np.uint64))
    return out


def _binary(grams: np.ndarray) -> pa.Array:
    n, width = len(grams), 4 * grams.shape[1]
    offsets = np.arange(n + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(grams, "<u4").tobytes())])


def _counted(folder: str, shards: int, first: list[int], order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at, held, n = hs.Store(folder, shards, lm._WORD), np.array(first, np.int64), [], 0

        def out() -> pa.RecordBatch:
            grams = np.concatenate(held)
            _, where, counts = np.unique(_key(grams), return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([_binary(grams[where]), pa.array(counts.astype(np.int64))], names=["g", "c"])

        for _, _, _, tokens in lm._sliced(batches, 0):
            numbers, _, _ = lm._numbers(store, at, tokens.hashes)
            held.append(_history(numbers, tokens.begins, order))
            n += len(numbers)
            if n >= lm.AT_ONCE:
                yield out()
                held, n = [], 0
        if held:
            yield out()

    return run


def _store(rows: DataFrame, name: str, kinds: dict[str, str]) -> tuple[str, int]:
    """Write ``(g, value...)`` as a store keyed by the hash of ``g``."""
    spark, names = rows.sparkSession, list(kinds)
    shards = 1 << max(0, (rows.count() >> 20).bit_length())
    bits, folder = shards.bit_length() - 1, scratch(spark, name)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = b"".join(batch.column(0).to_pylist())
            grams = np.frombuffer(data, "<u4").reshape(batch.num_rows, -1) if data else np.zeros((batch.num_rows, 0), np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array(_key(grams).view(np.int64)), *batch.columns[1:]], names=["key", *names])

    def write(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(key=group["key"].to_numpy(np.int64).view(np.uint64)).sort_values("key")
        hs.write_shard(folder, f"{int(key[0]):06d}", group["key"].to_numpy(), {c: group[c].to_numpy().astype(kinds[c]) for c in names})
        return pd.DataFrame({"n": [len(group)]})

    made = rows.select("g", *names).mapInArrow(keyed, "key bigint, " + ", ".join(f"{c} bigint" for c in names))
    shard = F.shiftrightunsigned("key", 64 - bits).cast("int") if bits else F.lit(0)
    made.withColumn("shard", shard).groupBy("shard").applyInPandas(write, "n bigint").agg(F.sum("n")).first()
    return folder, shards


def fit(texts: DataFrame, order: int) -> Model:
    """Fit on the one column of ``texts``.  Null counts as empty; an empty table gives a model without words."""
    if order < 1:
        raise ValueError("the order has to be at least 1")
    texts = texts.select(F.col(texts.columns[0]).cast("string").alias("text"))
    vocabulary, shards, first, tokens, known = lm.number_words(texts)
    level = texts.mapInArrow(_counted(vocabulary, shards, first, order), "g binary, c bigint").groupBy("g").agg(F.sum("c").alias("count"))
    counts, contexts, freed = [], [], []
    for k in range(order, 0, -1):
        level = durable(level, f"grams-{k}")
        seen = level.agg(*[F.count(F.when(F.col("count") == c, 1)) for c in (1, 2, 3, 4)]).first()
        counts.append(_store(level, f"counts-{k}", _COUNT))
        freed.append(discounts(list(seen)))
        exact = lambda c: F.count(F.when(F.col("count") == c, 1)).alias(f"n{c}")
        parts = level.groupBy(F.substring("g", 1, 4 * (k - 1)).alias("g"))
        parts = parts.agg(F.sum("count").alias("total"), exact(1), exact(2), F.count(F.when(F.col("count") > 2, 1)).alias("n3"))
        parts = durable(parts, f"contexts-{k}")
        contexts.append(_store(parts, f"contexts-{k}", _CONTEXT))
        lower = level.groupBy(F.substring("g", 5, 4 * (k - 1)).alias("g")).agg(F.count(F.lit(1)).alias("count"))
        done, level = level, durable(lower, "lower") if k > 1 else lower
        drop(parts, done)
    return Model(order, (vocabulary, shards), first, tokens, known, counts[::-1], contexts[::-1], freed[::-1])


def _scoring(m: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, first = hs.Store(*m.words, lm._WORD), np.array(m.first, np.int64)
        counts, contexts = ([hs.Store(*x, kinds) for x in stores] for stores, kinds in ((m.counts, _COUNT), (m.contexts, _CONTEXT)))

        def look(where: hs.Store, grams: np.ndarray) -> dict[str, np.ndarray]:
            distinct, place = np.unique(_key(grams), return_inverse=True)
            return {name: v[place].astype(float) for name, v in where.find(distinct).items()}

        for batch, i, j, tokens in lm._sliced(batches, 1):
            numbers, found, place = lm._numbers(store, first, tokens.hashes)
            history, rows = _history(numbers, tokens.begins, m.order), j - i
            count = found["count"].astype(float)[place]
            base = np.log10((count + 0.1) / (m.tokens + 0.1 * (m.vocabulary + 1)))
            p = np.full(len(numbers), 1 / (m.vocabulary + 1))
            for k in range(1, m.order + 1):
                d = np.array([0.0, *m.discounts[k - 1]])
                grams = history[:, m.order - k :]
                c, seen = look(counts[k - 1], grams)["count"], look(contexts[k - 1], grams[:, :-1])
                free = d[1] * seen["n1"] + d[2] * seen["n2"] + d[3] * seen["n3"]
                mine = np.maximum(c - d[np.minimum(c, 3).astype(int)], 0) + free * p
                p = np.where(seen["total"] > 0, mine / np.maximum(seen["total"], 1), p)
            total = lambda v: np.bincount(tokens.row, v, rows)
            values = [np.bincount(tokens.row, minlength=rows), total((count > 0).astype(float)).astype(np.int64), total(base), total(np.log10(p))]
            keep = batch.slice(i, rows)
            yield pa.RecordBatch.from_arrays([keep.column(0), *map(pa.array, values)], names=["id", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_tokens (words and one end), n_known, base_score and score (log10 probabilities).

    Null and empty texts: the end alone.  Repeated rows and rows without id are scored like any other; texts count
    whole.  Empty table: no rows.  Other columns are ignored.  Perplexity: 10 ** (-score / n_tokens).
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scoring(model), f"id {kind}, {lm._SCORED}").withColumnRenamed("id", id_col)


def score_corpus(docs: DataFrame, order: int, id_col: str = "doc_id", text_col: str = "text", every: int = 10) -> DataFrame:
    """As ``lm.score_corpus``, by a model of any order."""
    model = fit(docs.filter(~lm.held_out(id_col, every)).select(text_col), order)
    columns = [id_col, lm.held_out(id_col, every).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens")]
    return score(docs, model, id_col, text_col).select(*columns, "base_score", "score")
