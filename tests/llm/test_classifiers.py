from __future__ import annotations

import itertools

import numpy as np
import pytest
from docs import TEXTS, awkward, nothing

from rankweave.llm import quality, toxicity

DATA = "/root/testdata/sf0.01"
NO_LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("module, label, least", [(quality, "quality", 0.95), (toxicity, "toxic", 0.9)])
def test_held_out_rows(spark, module, label, least):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = module.score_corpus(docs, labels).join(labels, "doc_id").filter("held_out").select(label, "predicted", "score").collect()
    assert len(rows) > 50 and np.mean([r[0] == r[1] for r in rows]) >= least
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_labels_of_held_out_rows_do_not_matter(spark, module):
    label, every, rest = ("quality", 3, 1) if module is quality else ("toxic", 5, 0)
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    held = quality.lb.held_out("doc_id", every, rest)
    from pyspark.sql import functions as F

    other = labels.withColumn(label, F.when(held, 1 - F.col(label)).otherwise(F.col(label)))
    a, b = (module.score_corpus(docs, x).orderBy("doc_id").toPandas() for x in (labels, other))
    assert np.allclose(a["score"], b["score"], atol=1e-4)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_awkward_rows_and_missing_labels(spark, module):
    none = spark.createDataFrame([], NO_LABELS)
    rows = module.score_corpus(awkward(spark), none).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
    one = spark.createDataFrame([(1, 1, 0), (6, 1, 0), (None, 0, 1), (7, None, None)], NO_LABELS)
    assert module.score_corpus(awkward(spark), one).count() == len(TEXTS)
    some = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 11)], NO_LABELS)
    found = module.score_corpus(awkward(spark), some).collect()
    same = {r["score"] for r in found if r["doc_id"] in (1, 6)}
    assert len(found) == len(TEXTS) and len(same) == 1
    assert module.score_corpus(nothing(spark), some).count() == 0


def test_marginals_against_all_paths():
    rng = np.random.default_rng(2)
    lengths = [1, 4, 3, 5]
    chain, place = np.repeat(range(4), lengths), np.concatenate([np.arange(n) for n in lengths])
    score, move = rng.normal(size=13), rng.normal(size=(2, 2))
    post, moves, _ = toxicity.marginals(score, chain, place, move)
    want, jumps, at = np.zeros(13), np.zeros((2, 2)), 0
    for n in lengths:
        total, mass, pair = 0.0, np.zeros(n), np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=n):
            p = np.exp(sum(score[at + i] * s for i, s in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:], strict=False)))
            total += p
            mass += p * np.array(path)
            for a, b in zip(path, path[1:], strict=False):
                pair[a, b] += p
        want[at : at + n], at = mass / total, at + n
        jumps += pair / total
    assert np.allclose(post, want) and np.allclose(moves, jumps)


def test_dual_descent_meets_its_conditions():
    rng = np.random.default_rng(3)
    r = rng.normal(size=40)
    rows = [np.flatnonzero(rng.random(40) < 0.3) for _ in range(60)]
    y = np.sign(np.array([r[k].sum() for k in rows]) + rng.normal(size=60))
    w = quality.dual_descent(rows, y, r, 0.5, 400)
    value = lambda w: 0.5 * (w**2).sum() + 0.5 * sum(max(0, 1 - y[j] * ((w[k] * r[k]).sum() + w[-1])) for j, k in enumerate(rows))
    best = value(w)
    assert all(value(w + 0.01 * rng.normal(size=41)) >= best - 1e-6 for _ in range(200))


def test_spans_are_code_points(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = toxicity.score_corpus(docs, labels).join(docs, "doc_id").filter("spans != ''").select("spans", "text").collect()
    assert rows
    for r in rows:
        for span in r["spans"].split(","):
            a, b = map(int, span.split(":"))
            assert r["text"][a:b].isalnum() and not r["text"][a - 1 : a].isalnum() and not r["text"][b : b + 1].isalnum()
