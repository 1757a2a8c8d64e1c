from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from docs import LONG, TEXTS, awkward, nothing

from rankweave.llm import bagminhash as bm
from rankweave.llm import text as words


def bag(t):
    w = (t or "").encode().lower().split()
    return Counter([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def likeness(a, b):
    small = sum((a & b).values())
    return small / max(1, sum((a | b).values()))


def brute(rows):
    bags = [bag(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (not bags[i] and not bags[j]) or (bags[i] and bags[j] and likeness(bags[i], bags[j]) >= 0.8):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return [(rows[i][0], least[find(i)]) for i in range(len(rows))], len(groups)


def corpus(seed=5):
    rng, rows = random.Random(seed), list(TEXTS)
    for k in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(3, 120))]
        rows.append((100 + 10 * k, " ".join(base)))
        for j in range(rng.randrange(0, 6)):
            other = list(base)
            for _ in range(rng.randrange(0, 5)):
                other[rng.randrange(len(other))] = f"v{rng.randrange(3000)}"
            rows.append((100 + 10 * k + 1 + j, " ".join(other)))
    rows.append((900, " ".join(["again"] * 400)))
    rows.append((901, " ".join(["again"] * 390)))
    rows.append((902, " ".join(["again"] * 200)))
    return rows


def test_classes_against_brute_force(spark):
    rows = corpus()
    want, classes = brute(rows)
    found = bm.near_duplicates(awkward(spark, rows)).collect()
    order = lambda x: [(a is None, a or 0, b is None, b or 0) for a, b in x]
    assert sorted(order((r["doc_id"], r["class_id"]) for r in found)) == sorted(order(want))
    kept = bm.deduplicate(awkward(spark, rows)).collect()
    assert len(kept) == classes and kept[0].__fields__ == awkward(spark).columns


def test_a_chain_is_one_class(spark):
    base, rows = [f"c{i}" for i in range(300)], []
    for k in range(30):
        base[k * 9] = f"d{k}"
        rows.append((k, " ".join(base)))
    want, _ = brute(rows)
    found = bm.near_duplicates(awkward(spark, rows)).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in found) == sorted(want)


def test_copies_linked_through_their_original_only(spark):
    rng, base = random.Random(8), [f"c{i}" for i in range(400)]
    rows = [(500, " ".join(base))]
    for k in range(80):
        other = list(base)
        for at in rng.sample(range(400), 8):
            other[at] = f"d{k}x{at}"
        rows.append((k, " ".join(other)))
    want, classes = brute(rows)
    mutual = [likeness(bag(rows[i][1]), bag(rows[i + 1][1])) for i in range(1, 80)]
    assert classes < 5 and np.mean(np.array(mutual) < 0.8) > 0.9
    found = bm.near_duplicates(awkward(spark, rows)).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in found) == sorted(want)


def test_the_exact_join_finds_what_hubs_miss(spark, monkeypatch):
    monkeypatch.setattr(bm, "_star", lambda members: members.selectExpr("node a", "node b", "0L degree").limit(0))
    passage = " ".join(f"p{i}" for i in range(60))
    rows = corpus(9) + [(2000 + k, " ".join(f"q{k}x{i}" for i in range(30)) + " " + passage) for k in range(40)]
    want, _ = brute(rows)
    found = bm.near_duplicates(awkward(spark, rows)).select("doc_id", "class_id").collect()
    assert sorted(map(str, found)) == sorted(f"Row(doc_id={i}, class_id={c})" for i, c in want)


def test_nothing_shared(spark):
    rows = [(1, "a b c d e f"), (2, "g h i j k l")]
    assert bm.near_duplicates(awkward(spark, rows)).filter("kept").count() == 2
    assert bm.near_duplicates(nothing(spark)).count() == 0 and bm.deduplicate(nothing(spark)).count() == 0


def test_signatures_agree_as_often_as_multisets():
    rng, texts, m = random.Random(3), [], 4096
    a = [f"w{rng.randrange(60)}" for _ in range(200)]
    texts = [" ".join(a), " ".join(a[:150] + a[:50]), " ".join(a * 3), LONG]
    data, offsets = words.raw(pa.array(texts))
    sig = bm.signatures(bm.Bags(words.Hasher(), data, offsets), m)
    bags = [bag(t) for t in texts]
    for i, j in itertools.combinations(range(4), 2):
        want = likeness(bags[i], bags[j])
        assert abs((sig[i] == sig[j]).mean() - want) < 4 * np.sqrt(max(want * (1 - want), 1e-3) / m) + 1e-3
