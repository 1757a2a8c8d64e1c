"""From raw documents to packed sequences: toxicity, near-duplicates, benchmark leaks, personal data, packing.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last keep the columns of
``documents``.  ``run`` writes each stage's rows as Parquet and gives them to the next.

In every stage null and empty texts, rows without id and repeated rows are rows like any other (near-duplicates: one row
of each class stays, texts without words being one class); texts count whole, whatever their length; an empty table
gives no rows; without labels or with an empty benchmark nothing is rejected.  Further columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm import bagminhash, decontam, labelled, packing, pii, toxicity
from rankweave.operators.numbering import remove, scoped, scratch


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below one half, learnt from the labels that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, "toxic", ~labelled.held_out("doc_id", 5, 0))
    return toxicity.reject(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the smallest id."""
    return bagminhash.deduplicate(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars, where there is one, follows the text."""
    masked = pii.sanitize(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document in a sequence of at most 4096 tokens."""
    return packing.pack(docs, keep_ids=False)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("pii", mask_personal_data),
    ("packing", pack),
]

# Trained models, token ids and signatures are beyond SQL; tests/llm compares every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.  What a stage writes for itself goes when its rows are written, and those go
    when the next stage's are; the last stage's stay, as the result reads them."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        with scoped(spark, name):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
