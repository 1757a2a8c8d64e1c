from __future__ import annotations

import math
import zlib
from collections import Counter

import pytest
from docs import TEXTS, awkward, nothing

from rankweave.llm import lm


def _tokens(t):
    return [*(t or "").encode().lower().split(), None]


def _brute(train):
    counts, pairs = Counter(), Counter()
    for t in train:
        before = "start"
        for w in _tokens(t):
            counts[w] += 1
            pairs[before, w] += 1
            before = w
    n, v = sum(counts.values()), len(counts)
    d2 = [0.0, *lm.discounts([sum(c == k for c in pairs.values()) for k in (1, 2, 3, 4)])]
    before = Counter(w for _, w in pairs)
    d1 = [0.0, *lm.discounts([sum(c == k for c in before.values()) for k in (1, 2, 3, 4)])]
    total, free = Counter(), Counter()
    for (u, _), c in pairs.items():
        total[u] += c
        free[u] += d2[min(c, 3)]
    types = len(pairs)
    spare = sum(d1[min(c, 3)] for c in before.values()) / types if types else 1.0

    def lower(w):
        return (max(before[w] - d1[min(before[w], 3)], 0) / types if types else 0) + spare / (v + 1)

    def p(u, w):
        if not total[u]:
            return lower(w)
        c = pairs[u, w]
        return (max(c - d2[min(c, 3)], 0) + free[u] * lower(w)) / total[u]

    def score(t):
        out, u = 0.0, "start"
        for w in _tokens(t):
            out += math.log10(p(u, w))
            u = w
        return out

    base = lambda t: sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in _tokens(t))
    return counts, n, base, score, p


@pytest.mark.parametrize("shard_bytes", [lm.SHARD_BYTES, 2000])
def test_against_brute_force(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(lm, "SHARD_BYTES", shard_bytes)
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in TEXTS]
    counts, n, base, score, p = _brute([t for (_, t), h in zip(TEXTS, held, strict=True) if not h])
    rows = lm.score_corpus(awkward(spark)).collect()
    key = lambda r: (str(r[0]), r[1], r[2], r[3], round(r[4], 6), round(r[5], 6))
    found = sorted(key((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["base_score"], r["score"])) for r in rows)
    want = sorted(
        key((i, h, len(_tokens(t)), sum(counts[w] > 0 for w in _tokens(t)), base(t), score(t)))
        for (i, t), h in zip(TEXTS, held, strict=True)
    )
    for a, b in zip(found, want, strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], abs=1e-5) and a[5] == pytest.approx(b[5], abs=1e-5)
    assert all(r["train_tokens"] == n for r in rows)
    assert sum(p(b"plain", w) for w in counts) + p(b"plain", b"unseen") == pytest.approx(1.0)


def test_empty(spark):
    assert lm.score_corpus(nothing(spark)).count() == 0
    one = lm.score_corpus(awkward(spark, [(0, "a")]), every=1).first()
    assert one["n_known"] == 0 and one["train_tokens"] == 0
