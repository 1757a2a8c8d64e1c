"""Item aggregates and their incremental forms."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.functions.scalars import age_days, decay
from rankweave.schema import ITEM_ID, TS, USER_ID, VALUE


def popularity(interactions: DataFrame) -> DataFrame:
    """``(item_id, count)``: every row counts, duplicates and null values included."""
    return interactions.groupBy(ITEM_ID).agg(F.count(F.lit(1)).alias("count"))


def recency(
    interactions: DataFrame, reference: datetime | date, halflife_days: float = 30.0
) -> DataFrame:
    """``(item_id, recency_score)``: every row decays with its calendar-day age at ``reference``."""
    weight = decay(age_days(F.col(TS), reference), halflife_days)
    return interactions.groupBy(ITEM_ID).agg(F.sum(weight).alias("recency_score"))


def merge_popularity(old: DataFrame, delta: DataFrame) -> DataFrame:
    """Counts of the old table plus counts of newly arrived interactions."""
    return (
        old.unionByName(popularity(delta))
        .groupBy(ITEM_ID)
        .agg(F.sum("count").alias("count"))
    )


def merge_recency(
    old: DataFrame,
    old_reference: date,
    delta: DataFrame,
    reference: date,
    halflife_days: float = 30.0,
) -> DataFrame:
    """Age the old scores to ``reference`` and add the decayed new interactions.

    Ages are calendar days, so ageing a whole table is one multiplication and the result equals a full
    recomputation.
    """
    shift = decay(F.datediff(F.lit(reference), F.lit(old_reference)), halflife_days)
    aged = old.select(ITEM_ID, (F.col("recency_score") * shift).alias("recency_score"))
    return (
        aged.unionByName(recency(delta, reference, halflife_days))
        .groupBy(ITEM_ID)
        .agg(F.sum("recency_score").alias("recency_score"))
    )


def sum_popularity(parts: Sequence[DataFrame]) -> DataFrame:
    """One count table from several."""
    return reduce(DataFrame.unionByName, parts).groupBy(ITEM_ID).agg(F.sum("count").alias("count"))


def sum_recency(parts: Sequence[tuple[DataFrame, date]], reference: date, halflife_days: float = 30.0) -> DataFrame:
    """One score table at ``reference`` from several, each with the day its scores are of."""
    aged = [
        p.select(ITEM_ID, (F.col("recency_score") * decay(F.datediff(F.lit(reference), F.lit(day)), halflife_days)).alias("recency_score"))
        for p, day in parts
    ]
    return reduce(DataFrame.unionByName, aged).groupBy(ITEM_ID).agg(F.sum("recency_score").alias("recency_score"))


def cluster_preferences(interactions: DataFrame, assignments: DataFrame) -> DataFrame:
    """``(cluster, item_id, cluster_score)`` with ``avg(value) * count(*)``.

    The average skips null values and the count does not; a pair with null values only scores null.
    Users without a cluster drop out.
    """
    return (
        interactions.join(assignments.select(USER_ID, "cluster"), USER_ID)
        .groupBy("cluster", ITEM_ID)
        .agg((F.avg(VALUE) * F.count(F.lit(1))).alias("cluster_score"))
    )


def label_frequency(df: DataFrame, column: str) -> DataFrame:
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("string").alias("label"))
        .agg(F.count(F.lit(1)).alias("freq"))
    )
