from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest
from docs import TEXTS, awkward, nothing
from test_native import _no_python

from rankweave.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int, number string, `odd.name` int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x", 2) for i, t, s in rows], SCHEMA)


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def fill(sizes, weights, epochs=3):
    """Round by round, as one would by hand: who is above stops, the excess goes to the rest by weight."""
    whole, clamped = sum(sizes.values()), set()
    while True:
        free = [s for s in sizes if s not in clamped]
        left = whole - sum(epochs * sizes[s] for s in clamped)
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        above = {s for s in free if share[s] > epochs * sizes[s]}
        if not above:
            return share | {s: epochs * sizes[s] for s in clamped}
        clamped |= above


def corpus(seed, sources):
    rnd, rows = random.Random(seed), []
    for i in range(600):
        s = sources[0] if rnd.random() < 0.4 else rnd.choice(sources)
        n = rnd.choice([0, 1, 5, 40, 40, 300]) if s != sources[-1] else rnd.choice([0, 1, 2])
        rows.append((i, " ".join(f"w{rnd.randrange(99)}" for _ in range(n)), s))
    return rows


@pytest.mark.parametrize("sources", [["b", "a", "é", "Z", None], ["only"], [f"s{i}" for i in range(37)]])
def test_targets_and_what_is_taken(spark, sources):
    rows = corpus(len(sources), sources)
    mixed = mixing.mix(table(spark, rows))
    got = {r["doc_id"]: r for r in mixed.collect()}
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    target = fill(sizes, {s: 1 + j % 3 for j, s in enumerate(order)})
    taken = defaultdict(int)
    assert len(got) == len(rows)
    for i, t, s in rows:
        r = got[i]
        assert r["size"] == words(t) and r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(target[s], rel=1e-12) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
        # Whole repetitions are the same for all documents of a source.
        whole = int(target[s]) // sizes[s] if sizes[s] else 0
        assert whole * r["size"] <= r["taken"] <= (whole + 1) * r["size"]
    assert all(target[s] - 1 < taken[s] <= target[s] for s in sizes)
    again = mixing.mix(table(spark, list(reversed(rows))).repartition(7)).collect()
    assert {r["doc_id"]: r["taken"] for r in again} == {i: r["taken"] for i, r in got.items()}


def test_given_weights_and_texts(spark):
    rows = corpus(9, ["a", "b", None])
    docs = table(spark, rows)
    weights = spark.createDataFrame([("a", 0.5), (None, 4.0), ("z", 1.0)], "source string, weight double")
    mixed = mixing.mix(docs, weights, epochs=2, seed=7)
    got = {r["doc_id"]: r["taken"] for r in mixed.collect()}
    assert all(got[i] == 0 for i, _, s in rows if s == "b")
    assert got != {r["doc_id"]: r["taken"] for r in mixing.mix(docs, weights, epochs=2, seed=8).collect()}
    out = defaultdict(list)
    for r in mixing.repeated(docs, mixed).collect():
        out[r["doc_id"]].append(r)
    for i, t, _ in rows:
        copies = sorted(out.get(i, []), key=lambda r: r["copy"])
        assert sum(words(r["text"]) for r in copies) == got[i] and [r["copy"] for r in copies] == list(range(len(copies)))
        assert all(r["text"] == t for r in copies[:-1]) and all(t.startswith(r["text"]) for r in copies)


def test_equal_rows_at_the_border(spark):
    # Nothing tells the rows apart, and a fraction of them has to be taken.
    rows = [(None, "a b c", "x")] * 50 + [(5, "one", "y")] + [(6, " ".join("w" * 500), "z")]
    got = mixing.mix(table(spark, rows)).collect()
    x = [r["taken"] for r in got if r["doc_id"] is None]
    target = next(r["target"] for r in got if r["doc_id"] is None)
    assert len(got) == 52 and int(target) == sum(x) and len({t // 3 for t in x}) <= 2 and sum(t % 3 > 0 for t in x) <= 1


def test_awkward_and_native(spark):
    from pyspark.sql import functions as F

    docs = awkward(spark).withColumn("source", F.when(F.col("doc_id") < 5, "s"))
    df = mixing.digest(docs)
    _no_python(df)
    rows = df.collect()
    assert df.columns == ["doc_id", "size", "source_size", "target", "taken"] and len(rows) == len(TEXTS)
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert mixing.mix(nothing(spark).withColumn("source", F.lit(None).cast("string"))).count() == 0
    empty = mixing.mix(table(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in empty] == [(0, 0.0, 0)] * 2
