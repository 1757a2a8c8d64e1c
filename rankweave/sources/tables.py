"""Canonical datasets over star-schema Parquet tables.

``retail``  orders: customers buy parts, the quantity is the value.
``clicks``  an event log whose item id sits in a JSON column.
``votes``   one choice per customer, value 1, a fixed list of options.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.operators.filters import candidates
from rankweave.operators.numbering import unpacked_sizes
from rankweave.schema import (
    ITEM_ID,
    TS,
    USER_ID,
    VALUE,
    Applies,
    Dataset,
    FeatureKind,
    FeatureSpec,
    InteractionType,
)

# The day after the last order, and after the last event.
RETAIL_REFERENCE = date(2001, 8, 2)
CLICKS_REFERENCE = date(2024, 2, 1)

# The options of the one-choice dataset.
VOTE_OPTIONS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    unpacked_sizes(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text(column: str):
    return F.col(column).cast("string")


def retail_interactions(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        text("o_custkey").alias(USER_ID),
        text("l_partkey").alias(ITEM_ID),
        F.col("l_quantity").cast("double").alias(VALUE),
        F.col("o_orderdate").cast("timestamp").alias(TS),
    )


def retail(spark: SparkSession, folder: str) -> Dataset:
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    users = (
        table(spark, folder, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            text("c_custkey").alias(USER_ID),
            F.col("c_mktsegment").alias("segment"),
            F.col("n_name").alias("nation"),
            F.col("c_acctbal").cast("double").alias("balance"),
        )
    )
    items = table(spark, folder, "part").select(
        text("p_partkey").alias(ITEM_ID),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("type"),
        F.col("p_size").cast("double").alias("size"),
        F.col("p_retailprice").cast("double").alias("price"),
    )
    specs = (
        FeatureSpec("segment", FeatureKind.CATEGORICAL, Applies.USER),
        FeatureSpec("nation", FeatureKind.CATEGORICAL, Applies.USER),
        FeatureSpec("balance", FeatureKind.NUMERIC, Applies.USER),
        FeatureSpec("brand", FeatureKind.CATEGORICAL, Applies.ITEM),
        FeatureSpec("type", FeatureKind.CATEGORICAL, Applies.ITEM),
        FeatureSpec("size", FeatureKind.NUMERIC, Applies.ITEM),
        FeatureSpec("price", FeatureKind.NUMERIC, Applies.ITEM),
    )
    return Dataset("retail", retail_interactions(spark, folder), users, items, specs)


def clicks(spark: SparkSession, folder: str) -> Dataset:
    interactions = table(spark, folder, "events").select(
        text("user_id").alias(USER_ID),
        F.get_json_object("props", "$.k").alias(ITEM_ID),
        F.col("value").cast("double").alias(VALUE),
        F.col("ts").cast("timestamp").alias(TS),
    )
    return Dataset(
        "clicks",
        interactions,
        interactions.select(USER_ID).distinct(),
        candidates(interactions),
        interaction_type=InteractionType.IMPLICIT,
    )


def votes(spark: SparkSession, folder: str) -> Dataset:
    customer = table(spark, folder, "customer")
    interactions = customer.filter(F.col("c_mktsegment").isin(list(VOTE_OPTIONS))).select(
        text("c_custkey").alias(USER_ID),
        F.col("c_mktsegment").alias(ITEM_ID),
        F.lit(1.0).alias(VALUE),
        F.lit(date(2024, 1, 1)).cast("timestamp").alias(TS),
    )
    users = customer.select(text("c_custkey").alias(USER_ID), text("c_nationkey").alias("district"))
    items = catalog(spark, VOTE_OPTIONS)
    specs = (FeatureSpec("district", FeatureKind.CATEGORICAL, Applies.USER),)
    return Dataset("votes", interactions, users, items, specs)


def catalog(spark: SparkSession, names) -> DataFrame:
    """A literal item table, so that options nobody chose are candidates too."""
    return spark.createDataFrame([(n,) for n in names], f"{ITEM_ID} string")
