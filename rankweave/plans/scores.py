"""Normalised scores of a signal, kept sparse.

Scoring every candidate for every user would write users x items rows.  Most signals need far fewer:
popularity scores an item once for everybody, segments once per cluster, and rules touch only the
consequents a user meets, every other candidate sharing one score.  ``Scores`` holds just the distinct
numbers:

grain ``item``   ``listed(item_id, score)`` holds for every user.
grain ``group``  ``members(user_id, grp)`` assigns users, ``listed(grp, item_id, score)``.
grain ``user``   ``listed(user_id, item_id, score)``.

For ``group`` and ``user``, ``floor(key, floor)`` has one row per key the signal can score: the score of
every candidate that is not listed, or null if unlisted candidates get nothing.  A user without a row is
cold: the signal adds nothing and does not show in the breakdown.

``DenseScores`` describes a signal whose score is a dot product of two vectors; see ``dense.py``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.functions.scaling import MINMAX, scaled
from rankweave.schema import ITEM_ID, RAW_SCORE, SCORE, USER_ID

GROUP = "grp"

ITEM_GRAIN = "item"
GROUP_GRAIN = "group"
USER_GRAIN = "user"


@dataclass(frozen=True)
class Scores:
    signal: str
    grain: str
    listed: DataFrame
    floor: DataFrame | None = None
    members: DataFrame | None = None


@dataclass(frozen=True)
class DenseScores:
    """``users(user_id, features)`` times ``items(item_id, features)``, scaled per user.

    ``missing`` tells what a candidate without a vector gets: ``zero`` (raw score 0) or ``drop`` (it is
    not scored and adds nothing).
    """

    signal: str
    users: DataFrame
    items: DataFrame
    dim: int
    missing: str = "zero"
    method: str = MINMAX


def item_scores(
    signal: str, raw: DataFrame, candidates: DataFrame, method: str = MINMAX
) -> Scores:
    """``raw(item_id, raw_score)``; candidates that are not in it have raw score 0."""
    full = candidates.join(raw, ITEM_ID, "left").select(
        ITEM_ID, F.coalesce(F.col(RAW_SCORE).cast("double"), F.lit(0.0)).alias(RAW_SCORE)
    )
    stats = full.agg(
        F.struct(
            F.min(RAW_SCORE).alias("lo"),
            F.max(RAW_SCORE).alias("hi"),
            F.avg(RAW_SCORE).alias("mean"),
            F.stddev_pop(RAW_SCORE).alias("sd"),
        ).alias("stats")
    ).scalar()
    fields = {f: stats.getField(f) for f in ("lo", "hi", "mean", "sd")}
    listed = full.select(ITEM_ID, scaled(F.col(RAW_SCORE), fields, method).alias(SCORE))
    return Scores(signal, ITEM_GRAIN, listed)


def keyed_scores(
    signal: str,
    grain: str,
    raw: DataFrame,
    keys: DataFrame,
    candidates: DataFrame,
    *,
    members: DataFrame | None = None,
    method: str = MINMAX,
    unlisted: str = "zero",
) -> Scores:
    """Scale ``raw(key, item_id, raw_score)`` per key over all candidates.

    ``keys`` lists the groups or users the signal can score.  With ``unlisted="zero"`` candidates that
    are not in ``raw`` have raw score 0: they take part in minimum, maximum, mean and deviation without
    being written out.  With ``absent`` they are not scored at all.
    """
    key = GROUP if grain == GROUP_GRAIN else USER_ID
    raw = (
        raw.join(candidates.select(ITEM_ID), ITEM_ID, "left_semi")
        .join(keys.select(key), key, "left_semi")
        .select(key, ITEM_ID, F.coalesce(F.col(RAW_SCORE).cast("double"), F.lit(0.0)).alias(RAW_SCORE))
    )
    x = F.col(RAW_SCORE)
    stats = raw.groupBy(key).agg(
        F.min(x).alias("lo"),
        F.max(x).alias("hi"),
        F.avg(x).alias("mean"),
        F.var_pop(x).alias("var"),
        F.count(x).alias("n"),
    )
    if unlisted == "zero":
        size = candidates.agg(F.count(F.lit(1))).scalar()
        gap = F.col("n") < F.col("total")
        scale = (
            keys.select(key)
            .join(stats, key, "left")
            .fillna({"lo": 0.0, "hi": 0.0, "mean": 0.0, "var": 0.0, "n": 0})
            .withColumn("total", size)
            .withColumn("lo", F.when(gap, F.least("lo", F.lit(0.0))).otherwise(F.col("lo")))
            .withColumn("hi", F.when(gap, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi")))
        )
    else:
        scale = stats.withColumn("total", F.col("n"))
    # Listed scores and the zeros of the others, merged around the common mean.
    share = F.col("n") / F.col("total")
    spread = share * F.col("var") + share * (1 - share) * F.col("mean") * F.col("mean")
    mean = share * F.col("mean")
    scale = scale.select(key, "lo", "hi", mean.alias("mean"), F.sqrt(spread).alias("sd"))
    fields = {f: F.col(f) for f in ("lo", "hi", "mean", "sd")}
    floor_value = (
        scaled(F.lit(0.0), fields, method) if unlisted == "zero" else F.lit(None).cast("double")
    )
    floor = scale.select(key, floor_value.alias("floor"))
    listed = raw.join(scale, key).select(key, ITEM_ID, scaled(x, fields, method).alias(SCORE))
    return Scores(signal, grain, listed, floor, members)
