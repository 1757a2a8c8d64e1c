"""Sorted hash arrays in the shared folder, mapped into memory by the workers that look things up.

A store is a folder of shards.  Shard s holds the keys whose leading bits say s, so all shards in order are
one sorted array of 64-bit keys, each with a row of values.  A shard is written by the one task that owns it,
under a name of its own first and renamed at the end: a repeated task writes the same file again.
"""

from __future__ import annotations

import os
import sys
import tempfile
import uuid

import numpy as np
from pyarrow import fs
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Which of ``shards`` (a power of two) a key belongs to: its leading bits."""
    bits = shards.bit_length() - 1
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def write_shard(folder: str, name: str, keys: np.ndarray, values: dict[str, np.ndarray]) -> None:
    """One file: number of keys, the sorted keys, then the value arrays one after the other."""
    where, path = fs.FileSystem.from_uri(folder)
    where.create_dir(path, recursive=True)
    draft = f"{path}/.{name}-{uuid.uuid4().hex}"
    with where.open_output_stream(draft) as out:
        out.write(np.array([len(keys)], "<u8").tobytes())
        out.write(np.ascontiguousarray(keys, "<u8"))
        for v in values.values():
            out.write(np.ascontiguousarray(v))
    where.move(draft, f"{path}/{name}")


class Store:
    """Looks keys up in a folder of shards.  ``kinds``: name and numpy type of each value, in file order."""

    def __init__(self, folder: str, shards: int, kinds: dict[str, str]):
        self.folder, self.shards, self.kinds, self.open = folder, shards, kinds, {}

    def _bytes(self, name: str) -> np.ndarray | None:
        where, path = fs.FileSystem.from_uri(f"{self.folder}/{name}")
        if where.get_file_info(path).type == fs.FileType.NotFound:
            return None
        if isinstance(where, fs.LocalFileSystem):
            return np.memmap(path, np.uint8, "r")
        # A store that cannot be mapped where it is: a local copy that goes when the worker does.
        with tempfile.TemporaryFile() as copy, where.open_input_stream(path) as data:
            while piece := data.read(1 << 24):
                copy.write(piece)
            copy.flush()
            return np.memmap(copy, np.uint8, "r", shape=(os.fstat(copy.fileno()).st_size,))

    def shard(self, s: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        if s not in self.open:
            data = self._bytes(f"{s:06d}")
            n = int(data[:8].view("<u8")[0]) if data is not None else 0
            at, found = 8 + 8 * n, {}
            for name, kind in self.kinds.items():
                size = np.dtype(kind).itemsize * n
                found[name] = data[at : at + size].view(kind) if n else np.zeros(0, kind)
                at += size
            self.open[s] = (data[8 : 8 + 8 * n].view("<u8") if n else np.zeros(0, "<u8"), found)
        return self.open[s]

    def find(self, keys: np.ndarray, missing: int = 0) -> dict[str, np.ndarray]:
        """The values of ascending distinct ``keys``; ``missing`` where a key is not stored.  ``index`` is the
        place of a key in its shard, -1 where it is not stored."""
        out = {name: np.full(len(keys), missing, kind) for name, kind in self.kinds.items()}
        out["index"] = np.full(len(keys), -1, np.int64)
        ends = np.searchsorted(shard_of(keys, self.shards), np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(ends)):
            part = keys[ends[s] : ends[s + 1]]
            stored, values = self.shard(int(s))
            if not len(stored):
                continue
            at = np.minimum(np.searchsorted(stored, part), len(stored) - 1)
            hit = stored[at] == part
            out["index"][ends[s] : ends[s + 1]][hit] = at[hit]
            for name, v in values.items():
                out[name][ends[s] : ends[s + 1]][hit] = v[at[hit]]
        return out


def squeeze(keys: np.ndarray) -> bytes:
    """Ascending keys as compressed bytes: differences, equal byte places together."""
    import pyarrow as pa

    steps = np.diff(keys, prepend=np.uint64(0))
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    return len(keys).to_bytes(8, "little") + pa.Codec("zstd").compress(planes.tobytes(), asbytes=True)


def unsqueeze(data: bytes) -> np.ndarray:
    import pyarrow as pa

    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[8:], 8 * n, asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def merge_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum the counts of equal keys over several ascending arrays."""
    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], (np.add.reduceat(counts, first) if len(first) else counts)


def drop(spark, stored: tuple[str, int]) -> None:
    """Delete a store that is not looked at any more."""
    from rankweave.operators.numbering import remove

    remove(spark, stored[0])


def store(keys, column: str, name: str, value: str | None = None) -> tuple[str, int]:
    """Write the distinct numbers of a column as a store: its folder and number of shards.

    With ``value``, a small integer column, a number keeps its largest value as ``value`` ("i1").  The table is
    read twice, so it should be a written one.
    """
    import pandas as pd
    from pyspark.sql import functions as F

    from rankweave.operators.numbering import scratch

    found = keys.select(F.col(column).alias("key"), (F.col(value) if value else F.lit(0)).alias("value"))
    found = found.filter(F.col("key").isNotNull() & F.col("value").isNotNull()).groupBy("key").agg(F.max("value").alias("value"))
    shards = 1 << max(0, (found.count() >> 20).bit_length())
    bits = shards.bit_length() - 1
    folder = scratch(keys.sparkSession, name)

    def write(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        numbers = group["key"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(numbers)
        values = {"value": group["value"].to_numpy()[order].astype("i1")} if value else {}
        write_shard(folder, f"{int(key[0]):06d}", numbers[order], values)
        return pd.DataFrame({"n": [len(numbers)]})

    shard = F.shiftrightunsigned("key", 64 - bits).cast("int") if bits else F.lit(0)
    found.withColumn("shard", shard).groupBy("shard").applyInPandas(write, "n bigint").agg(F.sum("n")).first()
    return folder, shards
