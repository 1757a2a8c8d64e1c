from __future__ import annotations

import json
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from docs import TEXTS, awkward, nothing
from tokenizers import Tokenizer

from rankweave.llm import packing
from rankweave.llm import text as words


@pytest.mark.parametrize("length, windows", [(4096, 64), (64, 2)])
def test_every_id_once(spark, length, windows):
    rows = packing.pack(awkward(spark), length=length, windows=windows).collect()
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = sorted(tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for _, t in TEXTS)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), "<u4")
        assert r["length"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids.tobytes())
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], ids))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    found = []
    for (_, n), parts in pieces.items():
        ids = [x for _, p in sorted(parts, key=lambda x: x[0]) for x in p.tolist()]
        for i in range(0, len(ids), n):
            found.append(tuple(ids[i : i + n]))
    if length == 4096:
        assert sorted(found) == want
    assert sum(len(p) for parts in pieces.values() for _, p in parts) == sum(map(len, want))
    for parts in sequences.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    assert sum(s for parts in sequences.values() for _, s in parts) >= 0.85 * length * (len(sequences) - 1)


def test_empty(spark):
    assert packing.pack(nothing(spark)).count() == 0


# Words that normalisation changes, that end in marks, that look like special tokens, and white space of all kinds.
HARD = [
    "কয়, হয়. क़. İ. Hello World WORLD, world.",
    "<|endoftext|> <|ENDOFTEXT|> a<|endoftext|>.",
    "don't I'll WE'RE it's. O'Neil's, 'S 's",
    "a.b.c. U.S.A. x.. y,, . , .,",
    None,
    "",
    " \t\x0b",
]
LETTERS = "abcXYZ .,'\n\t\r\x0b\x0c-<|>0123\u00e9\u00c0\u0995\u09df\u09bc\u0958\u0130\u017f\u00df\u0301\u00a0\u2003\u65e5\u672c\U0001f600\x85\x1c\u200b"


def _files(tmp_path):
    folder = packing.default_tokenizer().rsplit("/", 1)[0]
    cased = json.load(open(packing.default_tokenizer()))
    cased["normalizer"]["normalizers"] = [n for n in cased["normalizer"]["normalizers"] if n["type"] != "Lowercase"]
    (tmp_path / "cased.json").write_text(json.dumps(cased))
    return {"folded": packing.default_tokenizer(), "cased": str(tmp_path / "cased.json"), "bytes": f"{folder}/byte_bpe_50k.json"}


@pytest.mark.parametrize("kind", ["folded", "cased", "bytes"])
def test_ids_are_the_tokenizers(tmp_path, kind):
    rnd = random.Random(1)
    texts = HARD + ["".join(rnd.choice(LETTERS) for _ in range(rnd.randrange(30))) for _ in range(30000)]
    definition = open(_files(tmp_path)[kind]).read()
    encoder, tokenizer = packing.WordIds(definition, 2), Tokenizer.from_str(definition)
    data, offsets = words.raw(pa.array(texts))
    for i, j in words.slices(offsets, 1 << 14):
        ids, at = encoder.ids(data, offsets[i : j + 1])
        for k in range(i, j):
            assert ids[at[k - i] : at[k - i + 1]].tolist() == [*tokenizer.encode(texts[k] or "", add_special_tokens=False).ids, 2]


def test_a_full_memory_forgets(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    definition = open(packing.default_tokenizer()).read()
    encoder, tokenizer = packing.WordIds(definition, 2), Tokenizer.from_str(definition)
    texts = [f"some word{i % 90} Word{i}." for i in range(200)]
    data, offsets = words.raw(pa.array(texts))
    for i, j in words.slices(offsets, 300):
        ids, at = encoder.ids(data, offsets[i : j + 1])
        want = [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts[i:j]]
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == want


@pytest.mark.parametrize("limit, length", [(1, 10), (3, 20), (8, 50)])
def test_best_fit_and_the_fullest_leaves(limit, length):
    rnd = random.Random(limit)
    windows, plain = packing.Windows(limit, length), []
    for k in range(500):
        size = rnd.randrange(1, length)
        out = windows.put(size, (k, size))
        # The same by the words of the method: windows in order of opening, lists of pieces.
        used = [sum(s for _, s in w) for w in plain]
        fits = [j for j, u in enumerate(used) if u + size <= length]
        want = None
        if fits:
            j = max(fits, key=lambda j: (used[j], -j))
            plain[j].append((k, size))
            if used[j] + size == length:
                want = plain.pop(j)
        else:
            if len(plain) == limit:
                want = plain.pop(max(range(limit), key=lambda j: (used[j], -j)))
            plain.append([(k, size)])
        assert out == want and [p for _, p in windows.open] == plain and len(plain) <= limit


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("b", "some words"), ("a", None), (None, "x")], "key string, body string")
    rows = packing.pack(docs, id_col="key", text_col="body").collect()
    assert sorted((r["doc_id"] or "", r["doc_tokens"]) for r in rows) == [("", 2), ("a", 1), ("b", 3)]
