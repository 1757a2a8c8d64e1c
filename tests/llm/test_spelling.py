from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from docs import TEXTS, awkward, nothing

from rankweave.llm import spelling


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=2):
    forms, out = {}, {}
    for w, n in counts.items():
        others = sorted((x for x in counts if near(w, x)), key=lambda x: (-counts[x], x))
        forms[w] = others[0] if others and counts[others[0]] >= ratio * n else None
        out[w] = len(others)
    rows = set()
    for w, n in counts.items():
        root = w
        while forms[root]:
            root = forms[root]
        rows.add((w, forms[w], root, n, out[w], counts.get(forms[w])))
    return rows


@pytest.mark.parametrize("letters, longest", [("ab", 9), ("abé", 7), ("abcdefgh", 12)])
def test_pairs_against_all_pairs(spark, letters, longest):
    rnd = random.Random(longest)
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randrange(1, longest))) for _ in range(150)}
    for w in list(words):
        i = rnd.randrange(len(w))
        words |= {w[:i] + w[i + 1 :], w[:i] + rnd.choice(letters) + w[i:], w[:i] + rnd.choice(letters) + w[i + 1 :]} - {""}
    counts = {w: rnd.choice([1, 2, 3, 5, 9, 40, 200]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    pairs = [tuple(r) for r in spelling.near_pairs(df).select("a", "b").collect()]
    assert len(pairs) == len(set(pairs))
    assert {frozenset(p) for p in pairs} == {frozenset((a, b)) for a in words for b in words if a < b and near(a, b)}
    rows = spelling.group(df).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert {tuple(r) for r in rows} == brute(counts) and len(rows) == len(words)


def corpus():
    rnd = random.Random(2)
    stems = ["Recommendation", "colour", "Überraschung", "naïveté", "ÉCOLE", "analyse", "tokeniser", "abcde", "abcdef"]
    docs = []
    for i in range(300):
        words = []
        for _ in range(rnd.randrange(30)):
            w = rnd.choice(stems)
            if rnd.random() < 0.3:
                j = rnd.randrange(len(w))
                w = w[:j] + rnd.choice(["", w[j] * 2, "z"]) + w[j + 1 :]
            words.append(w)
        docs.append((i, ", ".join(words) + "."))
    return docs


@pytest.mark.parametrize("every", [97, 5])
def test_corpus(spark, every):
    docs = TEXTS + corpus()
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    rows = spelling.variants(awkward(spark, docs), every=every).collect()
    assert {tuple(r) for r in rows} == brute(counts) and len(rows) == len(counts) > 100


def test_few_words(spark):
    assert spelling.digest(nothing(spark)).count() == 0
    assert spelling.variants(awkward(spark, [(1, "short words here"), (2, None)])).count() == 0
    one = spelling.variants(awkward(spark, [(1, "alone alone alone")])).collect()
    assert [tuple(r) for r in one] == [("alone", None, "alone", 3, 0, None)]
