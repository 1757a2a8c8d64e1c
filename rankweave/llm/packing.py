"""Pack tokenised documents into sequences with a bounded number of open windows per partition.

Documents are taken as they come.  Full windows are cut off a long document and leave at once; its rest goes
into the open window where it fits best.  When it fits none, the fullest window leaves and a new one opens.
What is still open when a partition ends is merged: the windows of 32 partitions are laid end to end and
cut, so that one window per 32 partitions is padded.

State of a task: ``windows`` open windows of ``length`` ids.  No document is looked at as a whole table, so
work and memory do not depend on how documents repeat or which source they come from.
"""

from __future__ import annotations

import os
import re
import string
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.llm import text as words
from rankweave.llm.columns import bounded_batches
from rankweave.operators.numbering import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECE = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
# Partitions whose open windows are merged by one task.
MERGED = 32
# Words a worker remembers, and ids they may take.
REMEMBERED, REMEMBERED_IDS = 1 << 19, 1 << 23
# Words given to the tokenizer side by side.
JOINED = 256
_IDS = np.dtype("<u4")
# What may part words, and the marks that may end one.
_SPACES, _MARKS = "\t\n\x0b\x0c\r ", ".,"


class WordIds:
    """Ids of texts by any tokenizer, words encoded once and looked up by their hash from then on.

    Which white space parts words without leaving a trace, whether case matters and whether a final full stop or
    comma is a token of its own is tried out on the tokenizer.  Only plain words, ASCII letters with such a mark, are
    folded and cut; all others go to the tokenizer as they are.  If no white space parts words, a text is one word.
    """

    def __init__(self, definition: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_str(definition), end_id
        probes = [*string.ascii_lowercase, "word", "tokens", "unlikelihood", "qzx"]
        ids = self._encode
        trace = [x + y for x, y in zip(ids(probes), ids(probes[::-1]), strict=True)]
        parts = [c for c in _SPACES if ids([f"{c}{x}{c}{c}{y}{c}" for x, y in zip(probes, probes[::-1], strict=True)]) == trace]
        folded = ids([p.upper() for p in probes]) == ids([p.title() for p in probes]) == ids(probes)
        marks = [c for c in _MARKS if parts and ids([p + c for p in probes]) == [x + ids([c])[0] for x in ids(probes)]]
        # A mark between two words shows where the ids of the first one end.
        single = [(parts[0] + c + parts[0], ids([c])[0][0]) for c in marks if len(ids([c])[0]) == 1]
        self.fence, self.fence_id = single[0] if single else (None, None)
        names = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.lone = re.compile("|".join(re.escape(x) for x in [self.fence.strip(), *names])) if single else None
        self.exact, self.folded = words.Hasher(exact=True), words.Hasher(exact=not folded)
        self.exact.space[:] = False
        self.exact.space[[ord(c) for c in parts]] = True
        self.fold, self.mark, self.other = folded, np.zeros(256, bool), np.ones(256, bool)
        self.mark[[ord(c) for c in marks]] = True
        self.other[[ord(c) for c in string.ascii_letters]] = False
        self._forget()

    def _forget(self, keep: np.ndarray | None = None) -> None:
        """Start anew with the words that ``keep`` names."""
        if keep is None:
            self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            self.flat, self.again = np.zeros(0, _IDS), np.zeros(0, bool)
            return
        at, size = self.at[keep], self.size[keep]
        first = np.cumsum(size) - size
        self.flat = self.flat[np.repeat(at - first, size) + np.arange(int(size.sum()))]
        self.keys, self.at, self.size, self.again = self.keys[keep], first, size, np.zeros(len(first), bool)

    def _encode(self, found: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(found, add_special_tokens=False)]

    def _pieces(self, data: np.ndarray, offsets: np.ndarray):
        """Hash, row, start, end and plainness of what is looked up: words, marks of plain words apart."""
        found = self.exact.words(data, offsets)
        start, end, data = found.start, found.end, found.data
        strange = np.concatenate(([0], np.cumsum(self.other[data])))
        strange = strange[end] - strange[start]
        marked = (strange == 1) & (end - start > 1) & self.mark[data[end - 1]] if len(end) else np.zeros(0, bool)
        plain = (strange == 0) | marked
        hashes, stem = found.hashes, end - marked
        if self.fold or marked.any():
            hashes = np.where(plain, self.folded._ranges(data, start, stem), hashes)
        place = np.arange(len(start)) + np.cumsum(marked) - marked
        n = len(start) + int(marked.sum())
        spread = lambda x, y: _spread(n, place, x, place[marked] + 1, y)
        last = end[marked] - 1
        return (
            spread(hashes, self.exact._ranges(data, last, last + 1)),
            spread(found.row, found.row[marked]),
            spread(start, last),
            spread(stem, last + 1),
            spread(plain, np.zeros(len(last), bool)),
            data,
        )

    def _side_by_side(self, found: list[str]) -> list[np.ndarray]:
        """Ids of each word, many words in one text for the tokenizer, which costs about half.

        Words that hold the mark between them or the name of a special token go by themselves, and so does a text
        where the number of marks is not right.
        """
        out: list[np.ndarray] = [np.zeros(0, _IDS)] * len(found)
        lone = [k for k, w in enumerate(found) if self.lone.search(w)] if self.lone else list(range(len(found)))
        alone = set(lone)
        joint = [k for k in range(len(found)) if k not in alone]
        runs = [joint[i : i + JOINED] for i in range(0, len(joint), JOINED)]
        for run, ids in zip(runs, self._encode([self.fence.join([found[k] for k in run]) for run in runs]) if runs else (), strict=True):
            row = np.array(ids, _IDS)
            cuts = np.flatnonzero(row == self.fence_id).tolist()
            if len(cuts) != len(run) - 1:
                lone += run
                continue
            for k, a, b in zip(run, [-1, *cuts], [*cuts, len(row)], strict=True):
                out[k] = row[a + 1 : b]
        for k, ids in zip(lone, self._encode([found[k] for k in lone]) if lone else (), strict=True):
            out[k] = np.array(ids, _IDS)
        return out

    def _learn(self, keys: np.ndarray, found: list[str]) -> None:
        ids = self._side_by_side(found)
        size = np.array([len(x) for x in ids], np.int64)
        at = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, *ids])
        where = np.searchsorted(self.keys, keys)
        fresh = ((self.keys, keys), (self.at, at), (self.size, size), (self.again, False))
        self.keys, self.at, self.size, self.again = (np.insert(x, where, y) for x, y in fresh)

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows between ``offsets``, each with the end id, one after the other; where each row begins."""
        hashes, row, start, end, plain, data = self._pieces(data, offsets)
        distinct, place = np.unique(hashes, return_inverse=True)
        if len(self.keys) > REMEMBERED or len(self.flat) > REMEMBERED_IDS:
            # Most words are met once; if those that were met again are too many as well, all go.
            some = self.again if 2 * self.again.sum() <= REMEMBERED and 2 * self.size[self.again].sum() <= REMEMBERED_IDS else None
            self._forget(some)
        at = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
        new = self.keys[at] != distinct if len(self.keys) else np.ones(len(distinct), bool)
        self.again[at[~new]] = True
        if new.any():
            some = np.zeros(len(distinct), np.int64)
            some[place] = np.arange(len(place))
            found = [(data[start[k] : end[k]].tobytes().decode(), plain[k]) for k in some[new]]
            self._learn(distinct[new], [w.lower() if p and self.fold else w for w, p in found])
            at = np.searchsorted(self.keys, distinct)
        size, first = self.size[at][place], self.at[at][place]
        total, rows = int(size.sum()), len(offsets) - 1
        before = np.cumsum(size) - size
        out = np.full(total + rows, self.end, _IDS)
        # An id stands behind the end ids of the rows before its own.
        step = np.arange(total)
        out[step + np.repeat(row, size)] = self.flat[step + np.repeat(first - before, size)]
        lengths = np.bincount(row, size, rows).astype(np.int64) + 1
        return out, np.concatenate(([0], np.cumsum(lengths)))


def _spread(n: int, at: np.ndarray, x: np.ndarray, other: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.empty(n, x.dtype)
    out[at], out[other] = x, y
    return out


class Windows:
    """At most ``limit`` open windows; ``put`` returns a window that has to leave, or None."""

    def __init__(self, limit: int, length: int):
        self.limit, self.length = limit, length
        self.open: list[tuple[int, list]] = []

    def put(self, size: int, piece) -> list | None:
        room = [(self.length - used - size, j) for j, (used, _) in enumerate(self.open) if used + size <= self.length]
        if room:
            left, j = min(room)
            used, pieces = self.open[j]
            pieces.append(piece)
            self.open[j] = (used + size, pieces)
            return self.open.pop(j)[1] if left == 0 else None
        leaving = None
        if len(self.open) >= self.limit:
            j = max(range(len(self.open)), key=lambda j: self.open[j][0])
            leaving = self.open.pop(j)[1]
        self.open.append((size, [piece]))
        return leaving


class Rows:
    """Collects output rows and hands them out as record batches."""

    def __init__(self, keep_ids: bool, schema: pa.Schema):
        self.keep_ids, self.rows, self.schema = keep_ids, [], schema

    def sequence(self, number: int, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append(
                (doc, start, len(ids), zlib.crc32(ids.tobytes()), total, number, at, ids.tobytes() if self.keep_ids else None)
            )
            at += len(ids)

    def left_over(self, pieces: list) -> None:
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), None, total, None, None, ids.tobytes()))

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [()] * len(self.schema)
        self.rows = []
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema
        )


def _first_visit(definition: str, end_id: int, length: int, windows: int, keep_ids: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder = words.worker_state(f"ids-{zlib.crc32(definition.encode())}-{end_id}", lambda: WordIds(definition, end_id))
        open_windows, rows, number = Windows(windows, length), Rows(keep_ids, schema), part << 32
        for batch in batches:
            data, offsets = words.raw(batch.column(1))
            for i, j in words.slices(offsets):
                every, begin = encoder.ids(data, offsets[i : j + 1])
                for k, doc in enumerate(batch.column(0)[i:j].to_pylist()):
                    ids = every[begin[k] : begin[k + 1]]
                    full = len(ids) // length * length
                    for start in range(0, full, length):
                        rows.sequence(number, [(doc, start, ids[start : start + length], len(ids))])
                        number += 1
                    if full < len(ids):
                        # A copy, so that an open window does not hold on to the ids of all texts around.
                        leaving = open_windows.put(len(ids) - full, (doc, full, ids[full:].copy(), len(ids)))
                        if leaving:
                            rows.sequence(number, leaving)
                            number += 1
                    if len(rows.rows) >= 2000:
                        yield rows.batch()
        for _, pieces in open_windows.open:
            rows.left_over(pieces)
        yield rows.batch()

    return run


def _merge(length: int, keep_ids: bool, schema: pa.Schema):
    def run(key: tuple, left: pd.DataFrame) -> pd.DataFrame:
        number = (1 << 62) + (int(key[0]) << 32)
        rows, pieces, used = Rows(keep_ids, schema), [], 0
        left = left.sort_values(["doc_id", "start"], kind="stable", na_position="first")
        for doc, start, data, total in zip(left["doc_id"], left["start"], left["ids"], left["doc_tokens"], strict=True):
            ids, at = np.frombuffer(data, _IDS), 0
            doc = None if pd.isna(doc) else doc
            while at < len(ids):
                take = min(len(ids) - at, length - used)
                pieces.append((doc, int(start) + at, ids[at : at + take], int(total)))
                at, used = at + take, used + take
                if used == length:
                    rows.sequence(number, pieces)
                    number, pieces, used = number + 1, [], 0
        rows.sequence(number, pieces)
        return pd.DataFrame(rows.rows, columns=schema.names).astype({"doc_id": object})

    return run


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    length: int = 4096,
    windows: int = 64,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if
    ``keep_ids``, the ids as little-endian unsigned 32-bit numbers.

    A document is its ids followed by ``end_id``.  Each id lies in exactly one piece.  ``tokenizer`` is the
    file of a tokenizer; the driver reads it and ships it with the tasks.

    Ids keep their type.  Null and empty texts: one piece with the end id alone.  Repeated rows and rows without id are
    packed like any other, each on its own.  Texts of any length are tokenised whole.  Equal sizes: the window opened
    first.  Empty table: no rows.  Other columns are ignored, whatever their names.  Sequence numbers are unique but not
    dense.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        definition = f.read()
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    longs = [T.StructField(c, T.LongType()) for c in PIECE]
    piece = T.StructType([T.StructField("doc_id", source.schema["doc_id"].dataType), *longs, T.StructField("ids", T.BinaryType())])
    schema = to_arrow_schema(piece)
    visited = source.mapInArrow(_first_visit(definition, end_id, length, windows, keep_ids, schema), piece)
    # Written once: the texts are tokenised a single time, and a lost executor costs one partition.
    visited = durable(visited.withColumn("group", F.floor(F.spark_partition_id() / MERGED)), "pieces")
    done = visited.filter(F.col("sequence_id").isNotNull()).drop("group")
    rest = visited.filter(F.col("sequence_id").isNull())
    merged = rest.groupBy("group").applyInPandas(_merge(length, keep_ids, schema), piece)
    out = done.unionByName(merged)
    return out if keep_ids else out.drop("ids")
