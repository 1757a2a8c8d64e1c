"""Queries that SQL cannot express against slow versions of the same method, one text at a time."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from docs import TEXTS, awkward
from pyspark.sql import functions as F

from rankweave.llm import labelled as lb
from rankweave.llm import pii, quality, syncmers, toxicity
from rankweave.llm import text as words


def single(text, hasher):
    data, offsets = words.raw(pa.array([text or ""]))
    return data, offsets, hasher.words(data, offsets)


# -- op5 -------------------------------------------------------------------------------------------


def test_closed_syncmers_are_chosen_by_the_smallest_inner_part(spark):
    rnd = random.Random(6)
    texts = [" ".join(f"w{rnd.randrange(k)}" for _ in range(n)) for k in (1, 2, 5, 300) for n in (5, 6, 7, 40, 400)]
    hashes = F.transform(F.split("text", " "), lambda w: F.xxhash64(w))
    inner = F.zip_with(F.slice("h", 1, F.size("h") - 1), F.slice("h", 2, F.size("h") - 1), lambda a, b: F.xxhash64(a, b))
    rows = awkward(spark, list(enumerate(texts))).select("text", hashes.alias("h"), syncmers.anchors(F.col("text")).alias("a"))
    for r in rows.select("h", inner.alias("s"), "a").collect():
        want = []
        for i in range(len(r["h"]) - 4):
            parts = r["s"][i : i + 4]
            if min(parts) in (parts[0], parts[3]):
                want.append(i)
        assert [x["word"] for x in r["a"]] == (want or list(range(len(r["h"]) - 4)))


# -- op8 -------------------------------------------------------------------------------------------


def plain_words(text):
    return [(m.group().translate(LOWER), m.start(), m.end()) for m in re.finditer(r"[^\x00-/:-@\[-`{-\x7f]+", text)]


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def disclosures(texts, threshold, support=2):
    """Term and entity with their disclosure, by the formula of the module."""
    contexts, holders, documents = {}, Counter(), Counter()
    for text in texts:
        spans = pii.base_spans(text)
        found = plain_words(text)
        documents.update({w for w, _, _ in found})
        holders.update({(k, text[a:b].lower()) for k, a, b in spans})
        for k, a, b in spans:
            left = [x for x in found if x[2] <= a][-8:]
            right = [x for x in found if x[1] >= b][:8]
            near = left + right
            free = [w for w, s, e in near if len(w.encode()) >= 4 and not w[0].isdigit() and not any(s < y and e > x for _, x, y in spans)]
            contexts.setdefault((k, text[a:b].lower()), {})[tuple(w for w, _, _ in near)] = set(free)
    out = {}
    for entity, seen in contexts.items():
        if len(seen) < support or holders[entity] >= len(texts):
            continue
        for term, both in Counter(t for terms in seen.values() for t in terms).items():
            if both >= support:
                share = math.log2(both / len(seen) / (documents[term] / len(texts))) / -math.log2(holders[entity] / len(texts))
                if share >= threshold:
                    out[entity, term] = share
    return out


def test_disclosure_by_its_formula(spark):
    rnd, texts = random.Random(12), []
    for i in range(240):
        who = rnd.randrange(12)
        filler = [f"common{rnd.randrange(40)}" for _ in range(rnd.randrange(4, 25))]
        if rnd.random() < 0.5:
            at = rnd.randrange(len(filler))
            alias = [f"alias{who}"] if rnd.random() < 0.8 else [f"alias{rnd.randrange(12)}"]
            filler[at:at] = [*alias, f"Person{who}@host.org," if rnd.random() < 0.7 else f"10.0.0.{who}", "house"]
        elif rnd.random() < 0.2:
            filler.append(f"alias{who}")
        texts.append(" ".join(filler))
    texts += texts[:30]
    want = disclosures(texts, 0.5)
    docs = awkward(spark, list(enumerate(texts)))
    found = pii.disclosing_terms(docs, threshold=0.5).terms.collect()
    assert len(want) > 5 and sorted(round(r["disclosure"], 9) for r in found) == sorted(round(x, 9) for x in want.values())
    terms = {t for _, t in want}
    for r in pii.find(docs, threshold=0.5).collect():
        text = texts[r["doc_id"]]
        reach = [(a, b) for _, a, b in pii.base_spans(text)]
        mine = [f"term:{s}:{e}" for w, s, e in plain_words(text) if w in terms and not any(s < y and e > x for x, y in reach)]
        assert [x for x in r["spans"].split(",") if x.startswith("term")] == mine


# -- op2 -------------------------------------------------------------------------------------------


def shape(word, before):
    upper, lower = sum("A" <= c <= "Z" for c in word), sum("a" <= c <= "z" for c in word)
    data = word.encode()
    marks = sum(b < 128 and not chr(b).isalnum() for b in data)
    case = 3 if upper > 1 and not lower else 2 if upper > 1 else upper
    last = data[-1] if data[-1] < 128 and not chr(data[-1]).isalnum() else 0
    return case, min(2, sum("0" <= c <= "9" for c in word)), min(3, marks), last, before is not None and word.translate(LOWER) == before.translate(LOWER)


def features(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    shapes = [shape(w, found[i - 1] if i else None) for i, w in enumerate(found)]
    low = [w.translate(LOWER) for w in found]
    out = {("w", w) for w in low} | {("p", *p) for p in zip(low, low[1:], strict=False)}
    return out | {("s", *shapes[i : i + n]) for n in (1, 2, 3) for i in range(len(shapes) - n + 1)}


def labelled_docs(kind):
    rnd, rows, labels = random.Random(kind), [], []
    good, bad = [f"fine{i}" for i in range(30)], [f"Bad{i}!" for i in range(30)]
    for i in range(260):
        y = rnd.random() < 0.4
        pool = good + [f"word{k}" for k in range(60)] + (bad if y else [])
        lines = [" ".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 12))) for _ in range(rnd.randrange(1, 5))]
        rows.append((i, "\n".join(lines)))
        if i % 5:
            labels.append((i, int(y), int(y)))
    return rows + [t for t in TEXTS if t[0] is None or t[0] > 10], labels


def test_indicators_are_words_pairs_and_shapes():
    texts = [t for _, t in TEXTS if t is not None and len(t) < 200] + ["A bB CC c c. 12 3a! ..", "X x x X x?", "É é ß z9Z"]
    hasher, found = words.Hasher(), []
    for t in texts:
        _, _, w = single(t, hasher)
        row, place = quality.indicators(w)
        assert not row.any() and len(place) == len(features(t))
        found.append(set(place.tolist()))
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert len(found[i] & found[j]) == len(features(a) & features(b))


def test_quality_query(spark):
    rows, labels = labelled_docs("quality")
    docs = awkward(spark, rows)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.score_corpus(docs, table).collect() if r["doc_id"] is not None}
    hasher = words.Hasher()
    place = {i: quality.indicators(single(t, hasher)[2])[1] for i, t in rows if i is not None}
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    learn = [(i, y) for i, y, _ in labels if not held(i)]
    counts = np.zeros((2, 1 << quality.BITS))
    for i, y in learn:
        counts[y, place[i]] += 1
    r = np.log(((counts[1] + 1) / (counts[1] + 1).sum()) / ((counts[0] + 1) / (counts[0] + 1).sum()))
    sample = sorted(((y, place[i].astype("<i4").tobytes()) for i, y in learn))
    sets, y = [np.frombuffer(d, "<i4") for _, d in sample], np.array([y for y, _ in sample])
    test = np.arange(len(y)) % 4 == 3
    fit = np.flatnonzero(~test)
    w = quality.dual_descent([sets[k] for k in fit], 2 * y[fit] - 1, r, 0.01)
    margin = lambda s: (w[:-1] * r)[s].sum() + w[-1]
    share = [1 - y.mean(), y.mean()]
    weight = np.array([share[v] / (y[test] == v).sum() for v in y[test]]) * test.sum()
    a, b = lb.calibrate(np.array([margin(sets[k]) for k in np.flatnonzero(test)]), y[test], weight)
    for i, s in place.items():
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-(a * margin(s) + b))), abs=1e-4) and got[i]["held_out"] == held(i)


# -- op7 -------------------------------------------------------------------------------------------


def tokens(text):
    """Lower-cased tokens by line."""
    return [[w for w, _, _ in plain_words(line)] for line in (text or "").split("\n")]


def evidence(word):
    data = word.encode()
    return {(0, data)} | {(j, data[:n]) for j, n in enumerate((4, 5, 6, 7, 8), 1)}


def test_marks_of_toxic_tokens(spark):
    rows, labels = labelled_docs("toxic")
    docs, table = awkward(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    (folder, shards), _ = lb.store_labels(table, "doc_id", "toxic", F.lit(True), 1200)
    source = docs.select(F.xxhash64(F.col("doc_id").cast("bigint")).alias("key"), "text")
    counts = lb.dense_sum(source.mapInArrow(toxicity._count(folder, shards), "piece int, data binary"), 2, 1 << toxicity.EVIDENCE_BITS)
    made = source.mapInArrow(toxicity._label(folder, shards, toxicity.support(counts)), toxicity._LABELLED).collect()
    texts = dict(rows)
    seen = [Counter(), Counter()]
    for i, _, y in labels:
        seen[y].update({e for line in tokens(texts[i]) for w in line for e in evidence(w)})
    strong = {e: n for e, n in seen[1].items() if n >= 5 and n >= 0.9 * (n + seen[0][e])}
    want = []
    for i, _, y in labels:
        held = [max(strong.get(e, 0) for e in evidence(w)) for line in tokens(texts[i]) for w in line]
        want.append((y, tuple(int(y and h > 0 and h >= max(held) / 4) for h in held)))
    got = [(r["label"], tuple(toxicity._unpack(bytes(r["data"]))[:, toxicity.KINDS + 1].tolist())) for r in made]
    assert sorted(got) == sorted(want) and sum(map(sum, (m for _, m in want))) > 50


def plain_marginals(gain, move):
    """P(toxic) along one chain, by forward and backward sums."""
    n, e = len(gain), [(1.0, math.exp(min(30, max(-30, g)))) for g in gain]
    t = np.exp(move)
    ahead, back = [np.array(e[0])], [np.ones(2)]
    for k in range(1, n):
        ahead.append((ahead[-1] @ t) * np.array(e[k]))
        ahead[-1] /= ahead[-1].sum()
    for k in range(n - 1, 0, -1):
        back.append(t @ (back[-1] * np.array(e[k])))
        back[-1] /= back[-1].sum()
    both = [a * b for a, b in zip(ahead, reversed(back), strict=True)]
    return [float(b[1] / b.sum()) for b in both]


def test_scores_from_marginals(spark):
    rows, labels = labelled_docs("score")
    docs, table = awkward(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, table, "toxic", F.lit(True))
    got = [r for r in toxicity.tag(docs, model).collect() if r["doc_id"] is not None]
    hasher, texts = words.Hasher(marks=True), dict(rows)
    assert sum(r["predicted"] for r in got) > 20
    for r in got:
        data, offsets = words.raw(pa.array([texts[r["doc_id"]] or ""]))
        found = toxicity.Tokens(hasher, data, offsets)
        kinds = found.features()
        gain = [model.weights[-1] + sum(model.weights[k[j]] for k in kinds) for j in range(len(found.word))]
        post, at = [], 0
        for line in tokens(texts[r["doc_id"]]):
            for k in range(0, len(line), toxicity.CHAIN):
                n = len(line[k : k + toxicity.CHAIN])
                post += plain_marginals(gain[at : at + n], model.move)
                at += n
        assert at == len(gain)
        p = min(max([1e-6, *post]), 1 - 1e-6)
        z = math.log(p / (1 - p)) + math.log1p(sum(min(max(x, 1e-6), 1 - 1e-6) for x in post if x >= 0.5))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-(model.slope * z + model.shift))), abs=1e-6)
        assert r["spans"].count(":") == sum(x >= 0.5 for x in post)
