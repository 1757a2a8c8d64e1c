"""The named queries of these operators over the given tables."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from rankweave.llm import (
    bagminhash,
    decontam,
    licenses,
    lm,
    mixing,
    packing,
    pii,
    quality,
    repeats,
    secrets,
    spelling,
    syncmers,
    toxicity,
)

QUERIES = {}
ORACLES: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query
def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), keep_ids=False)


@_query
def op10_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score_corpus(table(spark, folder, "documents"))


@_query
def op5_syncmers(spark: SparkSession, folder: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, folder, "documents"))


@_query
def op9_blob_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digest(table(spark, folder, "documents"))


ORACLES["op9_blob_ledger"] = secrets.ORACLE


@_query
def op3_license_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


ORACLES["op3_license_sentences"] = licenses.ORACLE


@_query
def op8_disclosure(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(table(spark, folder, "documents"))


@_query
def op4_bagminhash(spark: SparkSession, folder: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, folder, "documents"))


@_query
def op2_nbsvm(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score_corpus(table(spark, folder, "documents"), table(spark, folder, "labels"))


@_query
def op7_crf(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_corpus(table(spark, folder, "documents"), table(spark, folder, "labels"))


@_query
def op6_latent_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@_query
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.digest(table(spark, folder, "documents"))


@_query
def op12_spelling_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.digest(table(spark, folder, "documents"))


ORACLES["op12_spelling_chunks"] = spelling.ORACLE


@_query
def op13_water_filling(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.digest(table(spark, folder, "documents"))


ORACLES["op13_water_filling"] = mixing.ORACLE


QUERIES["pipeline"] = corpus_pipeline.run
