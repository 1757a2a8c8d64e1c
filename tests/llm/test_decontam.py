from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from docs import TEXTS, awkward, nothing

from rankweave.llm import decontam

RNG = random.Random(4)


def prose(n):
    return [f"{RNG.choice('bcdfglmnprst')}{RNG.choice('aeiou')}{RNG.randrange(900)}" for _ in range(n)]


ITEMS = [(k, prose(RNG.randrange(14, 70))) for k in range(40)] + [(98, ["only", "four", "rare", "wordsx"]), (99, []), (None, prose(30))]


def tables(spark):
    rows, want = list(TEXTS), set()
    for k in range(200):
        rows.append((1000 + k, " ".join(prose(RNG.randrange(1, 300)))))
    for j, (k, item) in enumerate(ITEMS[:40]):
        body, at = prose(150), RNG.randrange(150)
        kept = list(item)
        if j % 3 == 1:  # a paraphrase: every sixth word replaced
            kept[::6] = prose(len(kept[::6]))
        if j % 3 == 2:
            kept = [w.upper() + "," for w in kept]
        rows.append((2000 + j, " ".join(body[:at] + kept + body[at:])))
        want.add((2000 + j, k))
    rows.append((3000, " ".join(prose(40) + ITEMS[-1][1])))
    want.add((3000, None))
    bench = spark.createDataFrame([(k, " ".join(w) if w else None) for k, w in ITEMS], "item_id long, text string")
    return awkward(spark, rows), bench, rows, want


def test_leaks_are_found_and_nothing_else(spark):
    docs, bench, rows, want = tables(spark)
    found = decontam.leaks(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want
    assert all(r["lcs"] >= 0.5 for r in found)
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in rows if i is None or i < 2000)


def test_several_groups_find_the_same(spark, monkeypatch):
    docs, bench, _, want = tables(spark)
    monkeypatch.setattr(decontam, "GROUP", 16)
    assert {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()} == want


def test_empty_tables(spark):
    docs, bench, rows, _ = tables(spark)
    assert decontam.leaks(nothing(spark), bench).count() == 0
    assert decontam.leaks(docs, bench.limit(0)).count() == 0
    assert decontam.decontaminate(docs, bench.limit(0)).count() == len(rows)


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert decontam.common(a, b) == table[-1, -1]


def test_svd_spans_the_rows():
    a = np.random.default_rng(0).standard_normal((30, 200)).astype(np.float32)
    v = decontam.random_svd(a, 256)
    assert v.shape == (200, 30) and np.allclose(a @ v @ v.T, a, atol=1e-3)


def test_items_of_common_words(spark):
    rng = random.Random(9)
    usual = [f"usual{k}" for k in range(24)]
    long, short = list(usual), usual[3:9]
    rng.shuffle(long)
    mixed = ["seldom1", *usual[::-1][:14], "seldom2"]
    rows, want = [], set()
    for k in range(90):
        body = [x for three in zip(prose(40), prose(40), rng.choices(usual, k=40), strict=True) for x in three]
        at = rng.randrange(120)
        for number, item in ((0, long), (1, short), (2, mixed)):
            if k % 9 == number:
                rows.append((k, " ".join(body[:at] + item + body[at:])))
                want.add((k, number))
        if k % 9 > 2:
            rows.append((k, " ".join(body)))
    bench = spark.createDataFrame([(n, " ".join(t), " ".join(t[-4:])) for n, t in enumerate((long, short, mixed))], "item_id long, text string, a string")
    docs = awkward(spark, rows)
    weight = decontam.inverse_frequency(docs.select("text"))
    place = decontam.Passages(decontam.words.Hasher(marks=True), *decontam.words.raw(pa.array([" ".join(usual)]))).place
    assert not weight[place].any()
    for answer in (None, "a"):
        found = decontam.leaks(docs, bench, answer_col=answer).collect()
        assert want <= {(r["doc_id"], r["item_id"]) for r in found}
        assert all(r["lcs"] == 1 and r["answer"] == 1 for r in found if (r["doc_id"], r["item_id"]) in want)
        assert all(r["lcs"] < 1 for r in found if (r["doc_id"], r["item_id"]) not in want) and len(found) < len(want) + 5


def test_copies_do_not_make_words_common(spark):
    item = prose(20)
    rows = [(k, " ".join(item)) for k in range(60)] + [(100 + k, " ".join(prose(40))) for k in range(40)]
    docs = awkward(spark, rows)
    weight = decontam.inverse_frequency(docs.select("text"))
    place = decontam.Passages(decontam.words.Hasher(marks=True), *decontam.words.raw(pa.array([" ".join(item)]))).place
    assert (weight[place] > 0).all()
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert {r["doc_id"] for r in decontam.leaks(docs, bench).collect()} == set(range(60))
