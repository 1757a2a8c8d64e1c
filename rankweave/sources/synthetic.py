"""Seeded random data, generated row by row on the executors.

A row's values depend on the seed and the row number only, so the same call gives the same rows on any
cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.schema import (
    ITEM_ID,
    TS,
    USER_ID,
    VALUE,
    Applies,
    Dataset,
    FeatureKind,
    FeatureSpec,
)

# Ranges of the generated columns.
AGE_GROUPS = ("young", "adult", "senior")
CATEGORIES = ("A", "B", "C", "D")
START = "2025-06-01 00:00:00"
SPAN_SECONDS = 365 * 24 * 3600


def _draw(seed: int, salt: str, n: int) -> Column:
    """Uniform whole number in 0 .. n - 1 for this row."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("id")), F.lit(n).cast("long"))


def _choice(seed: int, salt: str, values) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (_draw(seed, salt, len(values)) + 1).cast("int"))


def interactions(
    spark: SparkSession, n_users: int = 200, n_items: int = 100, n: int = 2000, seed: int = 42
) -> DataFrame:
    """Uniform user-item pairs, ratings 1 to 5, times within a year of the start."""
    start = F.unix_timestamp(F.lit(START).cast("timestamp"))
    return spark.range(n).select(
        F.concat(F.lit("u"), _draw(seed, "user", n_users)).alias(USER_ID),
        F.concat(F.lit("i"), _draw(seed, "item", n_items)).alias(ITEM_ID),
        (_draw(seed, "value", 5) + 1).cast("double").alias(VALUE),
        F.timestamp_seconds(start + _draw(seed, "ts", SPAN_SECONDS + 1)).alias(TS),
    )


def users(spark: SparkSession, n_users: int = 200, seed: int = 42) -> DataFrame:
    return spark.range(n_users).select(
        F.concat(F.lit("u"), F.col("id")).alias(USER_ID),
        _choice(seed, "age_group", AGE_GROUPS).alias("age_group"),
        F.round(_draw(seed, "activity", 10001) / 100, 2).alias("activity_level"),
    )


def items(spark: SparkSession, n_items: int = 100, seed: int = 42) -> DataFrame:
    return spark.range(n_items).select(
        F.concat(F.lit("i"), F.col("id")).alias(ITEM_ID),
        _choice(seed, "category", CATEGORIES).alias("category"),
        F.round(_draw(seed, "quality", 1001) / 100, 2).alias("quality_score"),
    )


def synthetic(
    spark: SparkSession, n_users: int = 200, n_items: int = 100, n_interactions: int = 2000, seed: int = 42
) -> Dataset:
    specs = (
        FeatureSpec("age_group", FeatureKind.CATEGORICAL, Applies.USER),
        FeatureSpec("activity_level", FeatureKind.NUMERIC, Applies.USER),
        FeatureSpec("category", FeatureKind.CATEGORICAL, Applies.ITEM),
        FeatureSpec("quality_score", FeatureKind.NUMERIC, Applies.ITEM),
    )
    return Dataset(
        "synthetic",
        interactions(spark, n_users, n_items, n_interactions, seed),
        users(spark, n_users, seed),
        items(spark, n_items, seed),
        specs,
    )
