"""Personal data: patterns, and terms whose company in the corpus gives a protected value away.

The base finds e-mail addresses, IP addresses, payment cards and telephone numbers.  Each value found is an
entity to protect.  A term discloses an entity if it stands near it more often than chance allows:

    disclosure(t, e) = log2(P(t near e) / P(t)) / -log2 P(e)

P(t near e) is the share of the different contexts of e (eight words on either side) that hold t, P(t) and
P(e) the shares of all documents that hold t and e, however often.  1 means that t occurs with e only.  An entity
that all documents hold is given away by no term.  A term that stands in two or more contexts of an entity and reaches ``threshold`` is a finding
wherever it occurs.  Contexts are counted once, so that copies of a document prove nothing.

Three visits to the texts: contexts, document frequency of candidate terms, findings.  Between visits only
contexts and terms move, summed before the shuffle; candidates and disclosing terms are sorted hash arrays
that workers map into memory, of any size.
"""

from __future__ import annotations

import re
import sys
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm import hashstore as hs
from rankweave.llm import text as words
from rankweave.llm.columns import through_arrow
from rankweave.operators.numbering import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The base kinds in the order they are listed, then the kind of a disclosing term.
KINDS = ("email", "ip", "card", "phone", "term")
NEAR = 8
SHORTEST = 4

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """By the @ signs, so that a long run without one costs nothing."""
    used, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > used and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            used = domain.end()
            yield start, used
        at = text.find("@", max(at + 1, used))


def _luhn(digits: str) -> bool:
    total = 0
    for j, c in enumerate(reversed(digits)):
        d = int(c) * (1 + j % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` in code points, by kind and start; a match that fails its check is dropped."""
    out = []
    if "@" in text:
        out += [(0, a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split(".")):
                    out.append((1, m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and _luhn(digits):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((3, m.start(), m.end()))
    return out


def _bytes_at(text: str, places: list[int]) -> list[int]:
    out, last, at = {}, 0, 0
    for p in sorted(set(places)):
        at += len(text[last:p].encode("utf-8", "surrogatepass"))
        out[p], last = at, p
    return [out[p] for p in places]


def _usable(found: words.Words) -> np.ndarray:
    """Words of four bytes and more that do not begin with a digit."""
    lead = found.data[found.start] if len(found) else np.zeros(0, np.uint8)
    return (found.end - found.start >= SHORTEST) & ((lead < 48) | (lead > 57))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _entity(kind: int, value: str) -> int:
    data = value.lower().encode() if kind == 0 else re.sub(r"[^0-9.]", "", value).encode()
    both = zlib.crc32(data, kind) << 32 | zlib.crc32(data[::-1], kind + 77)
    return both - (1 << 64) if both >= 1 << 63 else both


# ``holds`` is 1 for the first occurrence of the entity in a document and 0 for the others.
_CONTEXT = "entity bigint, context bigint, terms array<bigint>, holds int"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = words.Hasher(marks=True)
    for batch in batches:
        rows = []
        for value in batch.column(0):
            text = value.as_py()
            spans = base_spans(text) if text else []
            if not spans:
                continue
            data, offsets = words.raw(pa.array([text]))
            held: set[int] = set()
            found = hasher.words(data, offsets)
            usable = _usable(found)
            edges = _bytes_at(text, [p for _, a, b in spans for p in (a, b)])
            begins, ends = edges[::2], edges[1::2]
            for a, b in zip(begins, ends, strict=True):
                usable[np.searchsorted(found.end, a, "right") : np.searchsorted(found.start, b, "left")] = False
            for (kind, s, e), a, b in zip(spans, begins, ends, strict=True):
                left, right = np.searchsorted(found.end, a, "right"), np.searchsorted(found.start, b, "left")
                near = np.r_[max(0, left - NEAR) : left, right : min(len(found), right + NEAR)]
                context = words.mix(np.uint64(len(near)) + np.bitwise_xor.reduce(words.mix(found.hashes[near] + np.arange(len(near), dtype=np.uint64)), initial=np.uint64(0)).reshape(1))
                terms = np.unique(found.hashes[near[usable[near]]])
                entity = _entity(kind, text[s:e])
                rows.append((entity, int(_signed(context)[0]), _signed(terms).tolist(), int(entity not in held)))
                held.add(entity)
        columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.int64())), pa.array(columns[3], pa.int32())],
            names=["entity", "context", "terms", "holds"],
        )


def _frequency(folder: str, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, hasher, held = hs.Store(folder, shards, {}), words.Hasher(marks=True), []

        def out():
            keys, counts = hs.merge_counts(held)
            return pa.RecordBatch.from_arrays([pa.array(_signed(keys)), pa.array(counts)], names=["term", "n"])

        for batch in batches:
            data, offsets = words.raw(batch.column(0))
            for i, j in words.slices(offsets):
                found = hasher.words(data, offsets[i : j + 1])
                distinct, place = np.unique(found.hashes, return_inverse=True)
                known = store.find(distinct)["index"] >= 0
                hit = np.flatnonzero(known[place])
                pairs = np.unique(place[hit] * np.int64(j - i) + found.row[hit])
                at, counts = np.unique(pairs // max(1, j - i), return_counts=True)
                held.append((distinct[at], counts.astype(np.int64)))
                if sum(len(k) for k, _ in held) > 1 << 20:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return run


@dataclass
class Disclosing:
    """Where the disclosing terms lie; ``shards`` 0: there are none."""

    folder: str = ""
    shards: int = 0
    terms: DataFrame | None = None


def disclosing_terms(docs: DataFrame, text_col: str = "text", threshold: float = 0.8, support: int = 2) -> Disclosing:
    """Terms that give an entity away, with ``terms``: entity, term, disclosure."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    contexts = durable(texts.mapInArrow(_contexts, _CONTEXT), "contexts")
    entities = contexts.groupBy("entity").agg(F.sum("holds").alias("holders"))
    once = contexts.groupBy("entity", "context").agg(F.first("terms").alias("terms"))
    several = once.groupBy("entity").agg(F.count(F.lit(1)).alias("contexts")).filter(F.col("contexts") >= support)
    joint = once.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both"))
    joint = durable(joint.filter(F.col("both") >= support).join(several, "entity").join(entities, "entity"), "joint")
    if joint.isEmpty():
        return Disclosing()
    counted = texts.mapInArrow(_frequency(*hs.store(joint, "term", "candidates")), "term bigint, n bigint")
    frequency = counted.groupBy("term").agg(F.sum("n").alias("documents"))
    total = F.lit(float(docs.count()))
    share = F.log2((F.col("both") / F.col("contexts")) / (F.col("documents") / total)) / -F.log2(F.col("holders") / total)
    found = joint.join(frequency, "term").filter(F.col("holders") < total)
    found = durable(found.select("entity", "term", share.alias("disclosure")).filter(F.col("disclosure") >= threshold), "terms")
    if found.isEmpty():
        return Disclosing()
    return Disclosing(*hs.store(found, "term", "disclosing"), found)


def _all_spans(text: str, hits: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    spans = base_spans(text)
    taken = sorted((a, b) for _, a, b in spans)
    starts = [a for a, _ in taken]
    # Base spans of different kinds may lie inside each other, so the longest reach so far counts.
    reach = list(accumulate((e for _, e in taken), max))
    for a, b in hits:
        j = bisect_left(starts, b)
        if not j or reach[j - 1] <= a:
            spans.append((4, a, b))
    return spans


def _finding(folder: str, shards: int, replace: bool, at: int = 1):
    """Spans of every text, or the text with its spans replaced."""
    import hashlib

    def joined(spans) -> str:
        return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)

    def swapped(text: str, spans) -> str:
        out, at = [], 0
        for a, b, k in sorted((a, b, k) for k, a, b in spans):
            if b <= at:
                continue
            if a >= at:
                out += [text[at:a], f"[{KINDS[k].upper()}]"]
            at = b
        return "".join([*out, text[at:]]) if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, hasher = hs.Store(folder, shards, {}) if shards else None, words.Hasher(marks=True)
        for batch in batches:
            column = batch.column(at)
            data, offsets = words.raw(column)
            for i, j in words.slices(offsets):
                hits: dict[int, list[tuple[int, int]]] = {}
                if store:
                    found = hasher.words(data, offsets[i : j + 1])
                    distinct, place = np.unique(found.hashes, return_inverse=True)
                    known = np.flatnonzero((store.find(distinct)["index"] >= 0)[place])
                    if len(known):
                        points, base = words.code_points(found.data), offsets[i : j + 1] - offsets[i]
                        for w in known:
                            r = found.row[w]
                            hits.setdefault(int(r), []).append(tuple(int(points[x] - points[base[r]]) for x in (found.start[w], found.end[w])))
                rows, texts = [], []
                for r in range(j - i):
                    text = column[i + r].as_py()
                    spans = _all_spans(text or "", hits.get(r, []))
                    if replace:
                        texts.append(swapped(text, spans) if text else text)
                        continue
                    base = [s for s in spans if s[0] < 4]
                    counts = [sum(k == q for k, _, _ in base) for q in range(4)]
                    rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
                kept = batch.slice(i, j - i)
                if replace:
                    yield kept.set_column(at, batch.schema.field(at), pa.array(texts, pa.string()))
                else:
                    out = [pa.array(c) for c in zip(*rows, strict=True)]
                    yield pa.RecordBatch.from_arrays([kept.column(0), *out], names=["id", *NAMES])

    return run


NAMES = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row per document: the id, counts and SHA-256 of the base findings, and all findings as
    ``kind:start:end`` by kind and start.

    Null counts as empty.  Repeated rows give repeated rows; copies add no evidence against a term.  An empty
    table, or one without repeated entities, has no terms.  Other columns are ignored.
    """
    terms = disclosing_terms(docs, text_col, threshold)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kind}, " + ", ".join(f"{n} {'bigint' if n.startswith('n_') else 'string'}" for n in NAMES)
    return rows.mapInArrow(_finding(terms.folder, terms.shards, False), schema).withColumnRenamed("id", id_col)


def sanitize(docs: DataFrame, text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """The same rows and columns with every finding replaced by its kind in brackets; null stays null."""
    terms = disclosing_terms(docs, text_col, threshold)
    return through_arrow(docs, _finding(terms.folder, terms.shards, True, docs.columns.index(text_col)))
