from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from docs import TEXTS, awkward, nothing

from rankweave.llm import repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(x, least=24, times=3):
    """Every stretch of every period, its smallest period checked letter by letter."""
    out = []
    for q in range(1, len(x) // times + 1):
        i = 0
        while i + q < len(x):
            if x[i] != x[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            length = i - start + q
            w = x[start : start + length]
            if length >= max(least, times * q) and not any(w[d:] == w[:-d] for d in range(1, q)):
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(found, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(found) if i not in gone)


def changed(doc, found):
    h = zlib.crc32(str(doc).encode())
    if doc is None or h % 10 or not found:
        return found
    n, g = len(found), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [found[i] if i < a else found[a + (i - a) % p] for i in range(n)]


def texts(seed, letters, most):
    rnd, x = random.Random(seed), []
    while len(x) < rnd.choice([0, 10, 40, 120, most]):
        unit = [rnd.randrange(letters) for _ in range(rnd.randrange(1, 14))]
        x += unit * rnd.randrange(1, 9) + unit[: rnd.randrange(len(unit))] if rnd.random() < 0.6 else unit
    return x


@pytest.mark.parametrize("least, times", [(24, 3), (6, 2), (8, 4)])
@pytest.mark.parametrize("letters", [1, 2, 3, 40])
def test_runs_of_random_words(least, times, letters):
    for seed in range(150):
        x = texts(seed, letters, 300)
        assert sorted(repeats.find_runs(np.array(x, np.int64), least, times), key=lambda r: (r[0], r[2])) == brute(x, least, times)


@pytest.mark.parametrize("x", [[], [1], [1, 1], [3, 1, 2, 1, 2], [0] * 9])
def test_suffixes(x):
    order, shared = repeats.suffix_order(np.array(x, np.int64))
    assert order.tolist() == sorted(range(len(x)), key=lambda i: x[i:])
    for k in range(1, len(x)):
        a, b = x[order[k - 1] :], x[order[k] :]
        assert shared[k] == next((j for j, (u, v) in enumerate(zip(a, b, strict=False)) if u != v), min(len(a), len(b)))


def test_places_are_ordered():
    rnd = random.Random(3)
    values = rnd.sample(range(20000), 3000)
    places, held = repeats.Places(values[0]), [values[0]]
    for p in values[1:]:
        below, above = [v for v in held if v < p], [v for v in held if v > p]
        assert places.add(p) == (max(below, default=-1), min(above, default=-1))
        held.append(p)
    assert list(places) == sorted(values)


def test_query(spark):
    rnd = random.Random(5)
    more = [(100 + i, " ".join(f"w{k}" for k in texts(i, rnd.choice([1, 2, 30]), 200))) for i in range(120)]
    more.append((300, "a b c\x0bd\x1fe " * 30))
    more.append((-4, "the same line of words\n" * 40))
    rows = repeats.digest(awkward(spark, TEXTS + more))
    assert rows.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = []
    for doc, text in TEXTS + more:
        found = changed(doc, WORD.findall(text or ""))
        # The one long text repeats 701 words, far too slow to take letter by letter for every period.
        runs = brute(found) if len(found) < 2000 else [(0, len(found), 701)] if changed(doc, found) == found and zlib.crc32(str(doc).encode()) % 10 else None
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None) if runs is not None else None
        if runs is None:
            continue
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        sha = [hashlib.sha256(t.encode()).hexdigest() for t in (listed, kept(found, runs))]
        want.append((doc, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *sha))
    got = [tuple(r) for r in rows.collect()]
    assert len(got) == len(TEXTS + more)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[-1])
    assert sorted((r for r in got if len(want) == len(got) or r[0] in {w[0] for w in want}), key=key) == sorted(want, key=key)
    assert sum(r[1] for r in got) > 60


def test_collapse_keeps_ids_and_texts(spark):
    docs = spark.createDataFrame([("x", "a b " * 20 + "c"), (None, None), ("y", "no repeats here")], "id string, body string")
    rows = {r["id"]: r for r in repeats.collapse(docs, id_col="id", text_col="body").collect()}
    assert rows["x"]["collapsed"] == "a b c" and [tuple(r) for r in rows["x"]["runs"]] == [(0, 40, 2)]
    assert rows[None]["runs"] == [] and rows[None]["collapsed"] == "" and rows["y"]["collapsed"] == "no repeats here"
    assert repeats.collapse(nothing(spark)).count() == 0 and repeats.digest(nothing(spark)).count() == 0
