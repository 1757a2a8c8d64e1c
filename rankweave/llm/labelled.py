"""What the two classifiers share: labels as a mapped array, a bounded sample, dense counts, calibration."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm import hashstore as hs

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Dense counts travel in pieces of so many numbers.
PIECE = 1 << 13


def held_out(id_col: str, every: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves ``rest``; a row without id never does."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % every == rest, F.lit(False))


def store_labels(labels: DataFrame, id_col: str, label: str, kept: Column, sample: int) -> tuple[tuple[str, int], int]:
    """A store of 0 and 1 by the hash of the id, and how large the numbers 2 and 3 (label + 2) make the sample.

    ``kept`` says which ids may be learnt from.  The sample has at most ``sample`` ids of either label, those
    with the smallest hashes.  A label that is null or neither 0 nor 1 is left out; of several labels of an
    id the larger counts.
    """
    good = labels.filter(kept & F.col(id_col).isNotNull() & F.col(label).isin(0, 1))
    rows = good.groupBy(id_col).agg(F.max(label).cast("int").alias("y")).select(F.xxhash64(F.col(id_col).cast("bigint")).alias("key"), "y")
    chosen = None
    for y in (0, 1):
        part = rows.filter(F.col("y") == y).orderBy("key").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = chosen.select("key", (F.col("y") + 2).alias("y"))
    return hs.store(rows.unionByName(chosen), "key", "labels", "y"), sample


LABEL = {"value": "i1"}


def look_up(store: hs.Store, keys: pa.Array) -> np.ndarray:
    """Label of each row: 0 or 1, plus 2 in the sample, -1 without a label."""
    numbers = keys.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    distinct, place = np.unique(numbers, return_inverse=True)
    return store.find(distinct, -1)["value"][place]


def dense_rows(counts: np.ndarray):
    """``(piece, data)`` rows of a matrix of counts, columns cut into pieces; empty pieces are left out."""
    codec = pa.Codec("zstd")
    for at in range(0, counts.shape[1], PIECE):
        part = np.ascontiguousarray(counts[:, at : at + PIECE].astype("<i8"))
        if part.any():
            yield at // PIECE, codec.compress(part.tobytes(), asbytes=True)


def dense_sum(rows: DataFrame, height: int, width: int) -> np.ndarray:
    """The sum of ``dense_rows`` by piece; what comes to the driver is one matrix."""

    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        codec, total = pa.Codec("zstd"), np.zeros(height * PIECE, np.int64)
        for data in group["data"]:
            total += np.frombuffer(codec.decompress(data, total.nbytes, asbytes=True), "<i8")
        return pd.DataFrame({"piece": [int(key[0])], "data": [codec.compress(total.tobytes(), asbytes=True)]})

    out, codec = np.zeros((height, width), np.int64), pa.Codec("zstd")
    for r in rows.groupBy("piece").applyInPandas(add, "piece int, data binary").collect():
        part = np.frombuffer(codec.decompress(bytes(r["data"]), height * PIECE * 8, asbytes=True), "<i8")
        out[:, r["piece"] * PIECE : (r["piece"] + 1) * PIECE] = part.reshape(height, PIECE)
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def calibrate(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton steps; targets are smoothed so that it stays finite."""
    n1, n0 = weight[y == 1].sum(), weight[y == 0].sum()
    if not n1 or not n0:
        return 0.0, float(np.log((n1 + 1) / (n0 + 1)))
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0

    def loss(a: float, b: float) -> float:
        z = a * margin + b
        return float((weight * (np.logaddexp(0, z) - target * z)).sum()) + 1e-6 * a * a

    for _ in range(50):
        p = sigmoid(a * margin + b)
        g, h = weight * (p - target), weight * p * (1 - p) + 1e-12
        grad = np.array([(g * margin).sum() + 2e-6 * a, g.sum()])
        hess = np.array([[(h * margin**2).sum() + 2e-6, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-9]])
        step, now, size = np.linalg.solve(hess, grad), loss(a, b), 1.0
        while size > 1e-4 and loss(a - size * step[0], b - size * step[1]) > now:
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        if abs(size * step).max() < 1e-7:
            break
    return float(max(a, 0.0)), float(b)
