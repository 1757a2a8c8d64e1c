from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from rankweave.llm import components, text
from rankweave.llm import hashstore as hs

TEXTS = ["Ab cd\tAB", None, "", " \n ", "é ÉA éa", "x" * 3000, "a.b,c", "\x1ca\x0bb", "日本 語"]


def _split(t):
    return (t or "").encode().lower().split()


def test_words_are_split_and_hashed_like_bytes():
    data, offsets = text.raw(pa.array(TEXTS))
    found = text.Hasher().words(data, offsets)
    want = [(i, w) for i, t in enumerate(TEXTS) for w in _split(t)]
    assert found.row.tolist() == [i for i, _ in want]
    by_word = {}
    for (_, w), h in zip(want, found.hashes.tolist(), strict=True):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_a_slice_of_a_column_hashes_the_same():
    whole = pa.array(["a b", "b c", "c d"])
    data, offsets = text.raw(whole.slice(1, 2))
    found = text.Hasher().words(data, offsets)
    data, offsets = text.raw(pa.array(["b c", "c d"]))
    assert found.hashes.tolist() == text.Hasher().words(data, offsets).hashes.tolist()


def test_grams():
    data, offsets = text.raw(pa.array(["a b c d e f", "a b", "", "a b"]))
    h, row = text.grams(text.Hasher().words(data, offsets), 5)
    assert row.tolist() == [0, 0, 1, 3] and h[2] == h[3] and len(set(h.tolist())) == 3


def test_mix_is_undone():
    x = np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64)
    assert (text.unmix(text.mix(x)) == x).all()


def test_squeeze():
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 63, 500).astype(np.uint64))
    assert (hs.unsqueeze(hs.squeeze(keys)) == keys).all() and len(hs.unsqueeze(hs.squeeze(keys[:0]))) == 0


@pytest.mark.parametrize("shards", [1, 8])
def test_store(tmp_path, shards):
    keys = np.unique(text.mix(np.arange(1000, dtype=np.uint64)))
    part = hs.shard_of(keys, shards)
    for s in range(shards):
        mine = keys[part == s]
        hs.write_shard(str(tmp_path), f"{s:06d}", mine, {"v": (mine % np.uint64(97)).astype("<u4")})
    store = hs.Store(f"file://{tmp_path}", shards, {"v": "<u4"})
    ask = np.unique(text.mix(np.arange(500, 1500, dtype=np.uint64)))
    found, here = store.find(ask), np.isin(ask, keys)
    assert ((found["index"] >= 0) == here).all() and (found["v"] == np.where(here, ask % np.uint64(97), 0)).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (60, 100), (60, 50), (7, 7), (-3, 200)]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {50: 50, 60: 50, 100: 50, -3: -3, 200: -3}
    assert found == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
