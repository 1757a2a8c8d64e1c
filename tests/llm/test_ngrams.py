from __future__ import annotations

import math
from collections import Counter, defaultdict

import pytest
from docs import TEXTS, awkward, nothing

from rankweave.llm import lm, ngrams


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


class Plain:
    """The formula, on dictionaries of tuples."""

    def __init__(self, train, order):
        self.order, self.words = order, Counter(w for t in train for w in tokens(t))
        level = Counter()
        for t in train:
            padded = ["start"] * (order - 1) + tokens(t)
            level.update(tuple(padded[i : i + order]) for i in range(len(padded) - order + 1))
        self.levels = {}
        for k in range(order, 0, -1):
            after = defaultdict(Counter)
            for g, c in level.items():
                after[g[:-1]][g[-1]] = c
            self.levels[k] = level, after, [0.0, *ngrams.discounts([sum(c == n for c in level.values()) for n in (1, 2, 3, 4)])]
            level = Counter(g[1:] for g in level)

    def p(self, history, w):
        out = 1 / (len(self.words) + 1)
        for k in range(1, self.order + 1):
            level, after, d = self.levels[k]
            u = tuple(history[len(history) - k + 1 :])
            total = sum(after[u].values())
            if total:
                free = sum(d[min(c, 3)] for c in after[u].values())
                c = level[(*u, w)]
                out = (max(c - d[min(c, 3)], 0) + free * out) / total
        return out

    def score(self, text):
        padded = ["start"] * (self.order - 1) + tokens(text)
        return sum(math.log10(self.p(padded[i : i + self.order - 1], padded[i + self.order - 1])) for i in range(len(padded) - self.order + 1))


@pytest.mark.parametrize("order, shard_bytes", [(1, lm.SHARD_BYTES), (2, 2000), (3, 2000), (4, lm.SHARD_BYTES)])
def test_against_the_formula(spark, monkeypatch, order, shard_bytes):
    monkeypatch.setattr(lm, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(lm, "AT_ONCE", 3000)
    more = [(100 + i, " ".join(f"w{(i * j * j + j) % 11}" for j in range(i % 9))) for i in range(60)]
    train = awkward(spark, [t for t in TEXTS if len(t[1] or "") < 9000] + more[:40])
    plain = Plain([t for _, t in TEXTS if len(t or "") < 9000] + [t for _, t in more[:40]], order)
    model = ngrams.fit(train.select("text"), order)
    every = TEXTS + more
    rows = ngrams.score(awkward(spark, every), model).collect()
    key = lambda r: (str(r[0]), r[1], round(r[2], 5))
    want = sorted(key((i, len(tokens(t)), plain.score(t))) for i, t in every if len(t or "") < 9000)
    got = sorted(key((r["doc_id"], r["n_tokens"], r["score"])) for r in rows if r["n_tokens"] < 9000)
    for a, b in zip(got, want, strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-4)
    some = [list(g[:-1]) for g in list(plain.levels[order][0])[:20]]
    for u in some:
        assert sum(plain.p(u, w) for w in plain.words) + plain.p(u, b"unseen") == pytest.approx(1.0)


def test_the_second_order_is_the_bigram_model(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "discounts", lm.discounts)
    docs = awkward(spark)
    a = lm.score(docs, lm.fit(docs.select("text"))).collect()
    b = ngrams.score(docs, ngrams.fit(docs.select("text"), 2)).collect()
    key = lambda r: (str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 4), round(r["score"], 4))
    assert sorted(map(key, a)) == sorted(map(key, b))


def test_empty_tables(spark):
    assert ngrams.score(nothing(spark), ngrams.fit(nothing(spark).select("text"), 3)).count() == 0
    row = ngrams.score(awkward(spark, [(1, "a b")]), ngrams.fit(nothing(spark).select("text"), 3)).first()
    assert row["n_known"] == 0 and row["score"] == 0.0
    with pytest.raises(ValueError):
        ngrams.fit(nothing(spark).select("text"), 0)


def test_corpus(spark):
    rows = ngrams.score_corpus(awkward(spark), 3).collect()
    assert len(rows) == len(TEXTS) and all(r["score"] <= 0 and r["n_known"] <= r["n_tokens"] for r in rows)
    assert {r["train_tokens"] for r in rows} == {sum(len(tokens(t)) for i, t in TEXTS if i is None or not lm_held(i))}


def lm_held(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 10 == 0
