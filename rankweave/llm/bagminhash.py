"""Near-duplicates of multisets of word 5-grams by BagMinHash.

A document is the multiset of its word 5-grams, lower-cased in ASCII; fewer than five words are one gram.  Two
documents are alike if the sum of the smaller counts is at least 0.8 of the sum of the larger ones.

Signature.  The weight axis of a gram is cut at 1, 2, 4, 8, ...  Every piece of it has a Poisson process of
points with rate proportional to its length, the same in every document.  A point has a time, a place in its
piece and one of m components.  A document sees the points whose place lies below its count; a component of
its signature names the first point it sees there, so two documents agree in a component with probability
equal to their weighted Jaccard similarity.  Only points before a horizon matter, about m ln m for a document
whatever its size; the horizon is doubled for a document with a component left empty.

Plan.
1. One visit to the texts: a 64-bit number of the multiset (the node; equal for copies), signature, band keys.
2. The hub of a bucket is its node with most company over all its buckets: an original rather than one of its
   copies.  Every node is compared with the best of its hubs: first a piece of the signatures, which has to agree
   in 0.55 or more of 64 components, then exactly, on the grams of the nodes concerned, which a visit to the texts
   picks out through a sorted array mapped into memory.
3. Components of the links found.  The other hubs of a node follow where the components differ.
4. What is left are buckets that hold several components, mostly texts that share a passage without being alike.
   Their nodes are joined exactly: grams are ordered by how many of these texts hold them, rare ones first, and two
   texts that are alike share a gram among the first ones of both, before the last 0.8 of their weight.  The first such
   gram also bounds what they can share by what is left of each text, and this has to reach 4/9 of both weights; the
   join checks it, so that texts whose rare grams already take too much, the many loose copies of one text, make no
   pairs.  All that remain are compared on their grams, without the signatures.
5. Every row gets the smallest id of its class.

With 34 bands of 6 components, a pair of similarity 0.8 shares a bucket with probability 0.99997.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.llm import hashstore as hs
from rankweave.llm import text as words
from rankweave.llm.columns import bounded_batches
from rankweave.llm.components import components
from rankweave.operators.numbering import drop, durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

GRAM = 5
BANDS, ROWS = 34, 6
SIZE = BANDS * ROWS
# A pair is alike if SHARE[0] * smaller >= SHARE[1] * larger counts.
SHARE = (5, 4)
# Components kept to compare signatures, and the share of them that has to agree: five standard deviations
# below 0.8.
SKETCH, AGREE = 64, 0.55
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PIECE = np.uint64(0xD1B54A32D192ED03)


class Bags:
    """Grams of a slice of rows: ascending within a row, with counts; ``first`` has where a row begins."""

    def __init__(self, hasher: words.Hasher, data: np.ndarray, offsets: np.ndarray):
        found = hasher.words(data, offsets)
        h, row = words.grams(found, GRAM)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        self.rows = len(offsets) - 1
        self.gram, self.row = h[at], row[at]
        self.count = np.diff(np.append(at, len(h)))
        self.first = np.searchsorted(self.row, np.arange(self.rows + 1))

    def nodes(self) -> np.ndarray:
        """A number of each row's multiset; 0 for a row without words."""
        out = np.zeros(self.rows, np.uint64)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(words.mix(self.gram + _PIECE * self.count.astype(np.uint64)), dtype=np.uint64)))
        sums = sums[self.first[1:]] - sums[self.first[:-1]]
        some = self.first[1:] > self.first[:-1]
        out[some] = words.mix(sums[some]) | np.uint64(1)
        return out


def signatures(bags: Bags, m: int = SIZE) -> np.ndarray:
    """Rows x m, 32 bits each; rows without words stay 0."""
    weight = np.bincount(bags.row, bags.count, bags.rows)
    out = np.zeros((bags.rows, m), np.uint32)
    todo, spread = np.flatnonzero(weight > 0), math.log(m) + 4
    while len(todo):
        horizon = np.zeros(bags.rows)
        horizon[todo] = spread / weight[todo]
        use = horizon[bags.row] > 0
        gram, row, count = bags.gram[use], bags.row[use], bags.count[use]
        key, time, value = [], [], []
        low, length, piece = 0, 1, 0
        while len(gram):
            # Point t of a process has the number seed + t * _STEP, so points are made in growing batches.
            seed, clock = words.mix(gram + np.uint64(int(_PIECE) * piece & (1 << 64) - 1)), np.zeros(len(gram))
            r, c, limit, t, batch = row, count, horizon[row], 1, 1
            while len(seed):
                steps = _STEP * np.arange(t, t + batch, dtype=np.uint64)
                u = words.mix(seed[:, None] + steps)
                gaps = -np.log(((u >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / (m * length)
                times = clock[:, None] + np.cumsum(gaps, 1)
                live = times <= limit[:, None]
                at = np.nonzero(live)[0]
                v = words.mix(u[live])
                seen = low + (v & np.uint64(0xFFFFF)).astype(float) * (length / (1 << 20)) < c[at]
                key.append(r[at][seen] * m + ((v >> np.uint64(32)) % np.uint64(m)).astype(np.int64)[seen])
                time.append(times[live][seen])
                value.append((words.mix(v[seen]) >> np.uint64(32)).astype(np.uint32))
                go = live[:, -1]
                seed, clock, r, c, limit = seed[go], times[go, -1], r[go], c[go], limit[go]
                t, batch = t + batch, min(4 * batch, 256)
            piece += 1
            low, length = (1, 1) if piece == 1 else (2 * low, 2 * length)
            more = count > low
            gram, row, count = gram[more], row[more], count[more]
        key, time, value = np.concatenate(key), np.concatenate(time), np.concatenate(value)
        # Latest first, so that the earliest point of a component is written last and stays.
        order = np.argsort(time)[::-1]
        out.reshape(-1)[key[order]] = value[order]
        found = np.zeros(bags.rows * m, bool)
        found[key] = True
        full = found.reshape(bags.rows, m).all(1)
        out[todo[~full[todo]]] = 0
        todo, spread = todo[~full[todo]], 2 * spread
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    keys = np.tile(np.arange(BANDS, dtype=np.uint64), (len(sig), 1))
    parts = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    for j in range(ROWS):
        keys = words.mix(keys * _STEP + parts[:, :, j])
    return keys


def _bags(batches: Iterator[pa.RecordBatch]):
    hasher = words.Hasher()
    for batch in batches:
        data, offsets = words.raw(batch.column(batch.num_columns - 1))
        for i, j in words.slices(offsets):
            yield batch.slice(i, j - i), Bags(hasher, data, offsets[i : j + 1])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, bags in _bags(batches):
        nodes = bags.nodes()
        sig = signatures(bags)
        keys = band_keys(sig).view(np.int64)
        some = nodes != 0
        lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(some * BANDS))).astype(np.int32), pa.array(keys[some].ravel()))
        sigs = [sig[k, :SKETCH].tobytes() if some[k] else None for k in range(bags.rows)]
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), rows.column(1), pa.array(nodes.view(np.int64)), lists, pa.array(sigs, pa.binary())],
            names=["id", "key", "node", "bands", "sig"],
        )


def _wanted(folder: str, shards: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Bags]]:
    """Nodes and bags of the texts whose keys are stored, each text once per task."""
    store, sent = hs.Store(folder, shards, {}), set()

    def chosen() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            distinct, place = np.unique(keys, return_index=True)
            new = [k for k, known in zip(place, store.find(distinct)["index"] >= 0, strict=True) if known and keys[k] not in sent]
            sent.update(keys[new])
            yield batch.take(pa.array(new, pa.int64()))

    for _, bags in _bags(chosen()):
        yield bags.nodes().view(np.int64), bags


def _pick(folder: str, shards: int):
    """The grams of the texts whose keys are stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, bags in _wanted(folder, shards, batches):
            out = []
            for k, node in enumerate(nodes.tolist()):
                a, b = bags.first[k], bags.first[k + 1]
                counts = bags.count[a:b]
                out.append((node, hs.squeeze(bags.gram[a:b]), counts.astype("<u4").tobytes() if (counts > 1).any() else None))
            cols = list(zip(*out, strict=True)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["node", "grams", "counts"]
            )

    return run


def _holders(folder: str, shards: int):
    """``(gram, n)``: how many of the stored texts hold a gram, summed per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            grams, n = hs.merge_counts(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n)], names=["gram", "n"])

        for _, bags in _wanted(folder, shards, batches):
            held.append((bags.gram, np.ones(len(bags.gram), np.int64)))
            if sum(len(g) for g, _ in held) > 1 << 21:
                yield out()
        if held:
            yield out()

    return run


def _prefixes(folder: str, shards: int, ranks: tuple[str, int]):
    """``(node, gram, whole, rest)``: the grams that begin a text's order, of those that several texts hold, with the
    weight of the text and its weight from this gram on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = hs.Store(*ranks, {"value": "i1"})
        for nodes, bags in _wanted(folder, shards, batches):
            distinct, place = np.unique(bags.gram, return_inverse=True)
            rank = store.find(distinct)["value"][place]
            order = np.lexsort((bags.gram, rank, bags.row))
            weight, row = bags.count[order], bags.row[order]
            sums = np.concatenate(([0], np.cumsum(weight)))
            # Weight of the text from a gram on; rows are contiguous.
            rest = sums[bags.first[1:]][row] - sums[:-1]
            whole = np.diff(sums[bags.first])[row]
            keep = (SHARE[0] * rest >= SHARE[1] * whole) & (rank[order] > 0)
            columns = [nodes[row[keep]], bags.gram[order][keep].view(np.int64), whole[keep].astype(np.int64), rest[keep].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "gram", "whole", "rest"])

    return run


def _bag(grams: bytes, counts: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    keys = hs.unsqueeze(grams)
    return keys, (np.frombuffer(counts, "<u4").astype(np.int64) if counts else np.ones(len(keys), np.int64))


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """Sums of the smaller and of the larger counts of two bags."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    small = int(np.minimum(a[1][i], b[1][j]).sum())
    return small, int(a[1].sum() + b[1].sum()) - small


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pairs in batches:
        keep = np.zeros(len(pairs), bool)
        for k, row in enumerate(pairs.itertuples(index=False)):
            small, large = overlap(_bag(row.ga, row.ca), _bag(row.gb, row.cb))
            keep[k] = SHARE[0] * small >= SHARE[1] * large
        yield pairs.loc[keep, ["a", "b"]]


def _texts_of(nodes: DataFrame, signed: DataFrame) -> tuple[str, int]:
    """A store of text keys, one for each of the nodes."""
    keys = signed.join(nodes.select("node").distinct(), "node").groupBy("node").agg(F.min("key").alias("key"))
    keys = durable(keys, "keys")
    stored = hs.store(keys, "key", "keys")
    drop(keys)
    return stored


def _agreeing(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The distinct pairs whose signatures agree in enough components to be worth a comparison, written out."""
    pairs = durable(pairs.distinct(), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sigs = signed.join(wanted, "node", "left_semi").select("node", "sig").dropDuplicates(["node"])
    both = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("x")), "a")
    both = both.join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("y")), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            near = [(np.frombuffer(x, np.uint32) == np.frombuffer(y, np.uint32)).mean() >= AGREE for x, y in zip(t["x"], t["y"], strict=True)]
            yield t.loc[np.array(near, bool), ["a", "b"]]

    near = durable(both.mapInPandas(run, "a bigint, b bigint"), "agreeing")
    drop(pairs)
    return near


def _verify(pairs: DataFrame, texts: DataFrame, signed: DataFrame) -> DataFrame:
    """The distinct pairs ``(a, b)`` of a written table that are alike, written out; the table goes."""
    stored = _texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), signed)
    picked = durable(texts.mapInArrow(_pick(*stored), "node bigint, grams binary, counts binary").dropDuplicates(["node"]), "grams")
    side = lambda x: picked.select(F.col("node").alias(x), F.col("grams").alias(f"g{x}"), F.col("counts").alias(f"c{x}"))
    links = durable(pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(_compare, "a bigint, b bigint"), "links")
    drop(pairs, picked)
    hs.drop(pairs.sparkSession, stored)
    return links


def _leftover_pairs(nodes: DataFrame, roots: DataFrame, texts: DataFrame, signed: DataFrame) -> DataFrame:
    """Candidate pairs across components among some nodes, written out; holds every pair of them that is alike."""
    stored = _texts_of(nodes, signed)
    holders = texts.mapInArrow(_holders(*stored), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    # The order of grams: by powers of two of their holders, in quarters, then by their number.
    rank = F.least(F.floor(F.log2("n") * 4), F.lit(127)).cast("int")
    several = durable(holders.filter(F.col("n") > 1).select("gram", rank.alias("n")), "holders")
    ranks = hs.store(several, "gram", "ranks", "n")
    columns = "node bigint, gram bigint, whole bigint, rest bigint"
    first = durable(texts.mapInArrow(_prefixes(*stored, ranks), columns).distinct(), "prefixes")
    known = first.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = known.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter(F.col("lo") < F.col("hi")).select("gram")
    left = durable(known.join(mixed, "gram"), "prefixes")
    right = left.select("gram", *[F.col(c).alias(f"{c}_b") for c in ("node", "root", "whole", "rest")])
    # What two texts share lies, from their first common gram on, in the rest of both; it has to be
    # SHARE[1] / (SHARE[0] + SHARE[1]) of both weights together.
    enough = sum(SHARE) * F.least("rest", "rest_b") >= SHARE[1] * (F.col("whole") + F.col("whole_b"))
    pairs = left.join(right, "gram").filter((F.col("node") < F.col("node_b")) & (F.col("root") != F.col("root_b")) & enough)
    pairs = durable(pairs.select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct(), "candidates")
    drop(several, first, left)
    for gone in (stored, ranks):
        hs.drop(nodes.sparkSession, gone)
    return pairs


def _members(signed: DataFrame) -> DataFrame:
    """``(key, node)`` of the buckets that hold different nodes."""
    rows = signed.filter(F.col("node") != 0).select("node", F.explode("bands").alias("key"))
    mixed = rows.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter(F.col("lo") < F.col("hi")).select("key")
    return durable(rows.join(mixed, "key").select("key", "node").distinct(), "buckets")


def _star(members: DataFrame) -> DataFrame:
    """``(a, b, degree)``, written out: a node b and the hub a of one of its buckets, with the hub's company.  Of equal
    company the larger node is the hub."""
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    degrees = members.join(sizes, "key").groupBy("node").agg(F.sum("n").alias("degree"))
    ranked = durable(members.join(degrees, "node"), "ranked")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("degree", "node")).alias("hub"))
    star = ranked.select("key", "node").join(hubs, "key").filter(F.col("node") != F.col("hub.node"))
    star = durable(star.select(F.col("hub.node").alias("a"), F.col("node").alias("b"), "hub.degree"), "star")
    drop(ranked)
    return star


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose nodes are not in one component."""
    for x in ("a", "b"):
        mine = roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
        pairs = pairs.join(mine, x, "left").withColumn(f"r{x}", F.coalesce(f"r{x}", x))
    return pairs.filter(F.col("ra") != F.col("rb")).select("a", "b")


def _open_nodes(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes of the buckets that hold several components."""
    known = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = known.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter(F.col("lo") < F.col("hi")).select("key")
    return durable(known.join(mixed, "key").select("node").distinct(), "open")


def _linked(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(rows, roots, links)``, written out: id and node of every row, component of every linked node, links."""
    text = F.col(text_col).cast("string").alias("text")
    key = F.xxhash64(F.col(text_col).cast("string")).alias("key")
    source = docs.select(F.col(id_col).alias("id"), key, text)
    fields = [T.StructField(c, T.LongType()) for c in ("key", "node")]
    fields += [T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())]
    signed = durable(source.mapInArrow(_sign, T.StructType([source.schema["id"], *fields])), "signed")
    texts = docs.select(key, text)
    members = _members(signed)
    links = signed.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    if members.isEmpty():
        roots = durable(links.toDF("node", "root"), "roots")
        links = durable(links, "links")
    else:
        star = _star(members)
        first = star.groupBy("b").agg(F.max(F.struct("degree", "a")).alias("hub")).select("hub.a", "b")
        links = _verify(_agreeing(first, signed), texts, signed)
        roots = components(links)

        def go_on(pairs: DataFrame) -> None:
            """Take what is alike among further pairs into links and components."""
            nonlocal links, roots
            if pairs.isEmpty():
                drop(pairs)
                return
            found = _verify(pairs, texts, signed)
            before = links, roots, found
            links = durable(links.unionByName(found), "links")
            roots = components(links)
            drop(*before)

        go_on(_agreeing(_apart(star.select("a", "b").distinct(), roots), signed))
        drop(star)
        left = _open_nodes(members, roots)
        if not left.isEmpty():
            go_on(_leftover_pairs(left, roots, texts, signed))
        drop(left)
    rows = durable(signed.select("id", "node"), "nodes")
    drop(signed, members)
    return rows, roots, links


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, node, root, class_id, links)`` for every row: ``class_id`` is the smallest id of its class, ``links`` how
    many different texts its text was found to be alike by comparing them.

    A class is connected by its links; pairs inside a class that need no comparison are not compared.  Ids keep their
    type.  Null counts as empty.  Rows without words are alike and make one class.  Equal rows share a class; a row
    without id takes part, and a class whose rows all lack an id has none.  Texts count whole, whatever their length.
    Empty table: no rows.  Other columns are ignored.
    """
    # Bags of long texts are large, and a pair has two of them.
    bounded_batches(docs.sparkSession)
    rows, roots, links = _linked(docs, id_col, text_col)
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    rows = rows.join(roots.join(ends, "node", "left"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rows.groupBy("root").agg(F.min("id").alias("class_id"))
    return rows.join(least, "root").select("id", "node", "root", "class_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``class_id``, ``kept`` (it is the one its class keeps) and ``links``; see
    ``classes``."""
    found = classes(docs, id_col, text_col)
    return found.select(F.col("id").alias(id_col), "class_id", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"), "links")


def _with_nodes(rows: DataFrame, text_col: str) -> DataFrame:
    """``(whole, node)``: each row as a struct, and the node of its text."""
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("whole"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, bags in _bags(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bags.nodes().view(np.int64))], names=["whole", "node"])

    return packed.mapInArrow(run, T.StructType([packed.schema["whole"], T.StructField("node", T.LongType())]))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class one row with the smallest id.

    All columns stay.  Of several rows with that id, or of a class without ids, one row stays.
    """
    found = durable(classes(docs, id_col, text_col), "classes")
    kept = found.filter(F.col("id").eqNullSafe(F.col("class_id"))).groupBy("root", "id").agg(F.min("node").alias("node"))
    counts = found.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    kept = durable(kept.join(counts.withColumnRenamed("id", "same"), F.col("id").eqNullSafe(F.col("same"))).drop("same"), "kept")
    here = docs[id_col]
    once = kept.filter(F.col("n") == 1).select(F.col("id").alias("_kept"))
    out = docs.join(once, here.eqNullSafe(F.col("_kept")), "left_semi")
    again = kept.filter(F.col("n") > 1)
    if again.isEmpty():
        return out
    # Rows that share their id are told apart by text; only they move as a whole a second time.
    rows = docs.join(again.select(F.col("id").alias("_kept")).distinct(), here.eqNullSafe(F.col("_kept")), "left_semi")
    rows = _with_nodes(rows, text_col).join(again.select("node", F.col("id").alias("_kept")), "node")
    rows = rows.filter(F.col(f"whole.`{id_col}`").eqNullSafe(F.col("_kept")))
    place = F.row_number().over(W.partitionBy("node", "_kept").orderBy(f"whole.`{text_col}`"))
    rows = rows.withColumn("_place", place).filter(F.col("_place") == 1)
    return out.unionByName(rows.select("whole.*"))
