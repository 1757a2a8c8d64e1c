from __future__ import annotations

import zlib
from pathlib import Path

import corpus_pipeline
import numpy as np
import pytest
from docs import TEXTS, awkward
from test_bagminhash import brute
from test_pii import brute as private
from tokenizers import Tokenizer

from rankweave.llm import packing
from rankweave.operators.numbering import scratch

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, DATA).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_columns_stay(spark, steps):
    want = spark.read.parquet(f"{DATA}/documents.parquet").columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "packing"]
    assert all(after.columns == want for _, after in steps[:-1])


def test_toxic_documents_go(spark, steps):
    before, after = steps[0]
    kept, labels = {r[0] for r in after.select("doc_id").collect()}, spark.read.parquet(f"{DATA}/labels.parquet").collect()
    there = {r[0] for r in before.select("doc_id").collect()}
    assert kept <= there and all(r["toxic"] or r["doc_id"] not in there - kept for r in labels)


def test_one_of_each_class_stays(steps):
    before, after = steps[1]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    want, _ = brute(rows)
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({c for _, c in want})


def test_leaks_go(spark, steps):
    before, after = steps[2]
    items = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    holds = {r["doc_id"] for r in before.collect() if any(i in " ".join((r["text"] or "").split()) for i in items)}
    assert {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in after.collect()} == holds


def test_personal_data_goes(steps):
    before, after = steps[3]
    assert before.count() == after.count()
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.collect():
        assert private(r["text"]) == "" and r["n_chars"] == len(r["text"])
        assert private(texts[r["doc_id"]]) or r["text"] == texts[r["doc_id"]] or "[TERM]" in r["text"]


def test_packed_whole(steps):
    before, after = steps[4]
    tokenizer, pieces = Tokenizer.from_file(packing.default_tokenizer()), {}
    for r in after.collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"]))
    for r in before.collect():
        ids = np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 2], "<u4")
        parts = sorted(pieces[r["doc_id"]])
        assert sum(n for _, n, _ in parts) == len(ids)
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in parts)


def test_run_leaves_what_its_result_reads(spark, steps):
    root = Path(scratch(spark, "x").removeprefix("file:")).parent
    before = set(root.iterdir())
    found = corpus_pipeline.run(spark, DATA)
    left = set(root.iterdir()) - before
    assert [p.name.split("-")[:2] for p in left] == [["stage", "packing"]] and found.count() > 0


@pytest.mark.parametrize("texts", [TEXTS, []])
def test_awkward_documents_go_through(spark, tmp_path, texts):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    awkward(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / name)
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        found = spark.read.parquet(out)
        if k < 4:
            assert found.columns == docs.columns
        # Without labels and items only copies go: one text twice, three without words.
        want = len(texts) if k == 0 else max(0, len(texts) - 5)
        assert found.count() == want if k < 4 else {r[0] for r in found.select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").collect()}
        docs = found
