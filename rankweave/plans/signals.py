"""The six signals, each a pair of plain functions.

``fit(features, params)`` learns artifacts (tables, MLlib models, settings) from the feature tables;
``score(artifacts, users, candidates, method)`` turns them into ``Scores`` or ``DenseScores`` that cover
at least the asked users.  A signal of
your own is another ``Signal`` in the dictionary you pass on.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import date, datetime
from typing import Any

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.functions.scaling import MINMAX
from rankweave.operators import aggregates, baskets
from rankweave.operators.encode import IdIndex, Vectors, vectorize
from rankweave.operators.filters import for_users, seen_items, with_value
from rankweave.operators.numbering import durable, ensure_checkpoint_dir
from rankweave.operators.profiles import user_profiles
from rankweave.plans.scores import (
    GROUP,
    GROUP_GRAIN,
    USER_GRAIN,
    DenseScores,
    Scores,
    item_scores,
    keyed_scores,
)
from rankweave.schema import (
    ITEM_ID,
    ITEM_IDX,
    RAW_SCORE,
    USER_ID,
    USER_IDX,
    VALUE,
    Applies,
    Dataset,
    FeatureSpec,
    InteractionType,
)

# Defaults that results depend on.
SEED = 42
DEFAULT_HALFLIFE_DAYS = 30.0
DEFAULT_CLUSTERS = 8
DEFAULT_RANK = 32
DEFAULT_REG = 0.1
DEFAULT_MAX_ITER = 10
# Factorisation: at least the library's ten blocks; a block reads the factors of what its ratings name.
ALS_BLOCKS = 10
ALS_BLOCK_RATINGS = 4_000_000
DEFAULT_MIN_SUPPORT = 0.01
DEFAULT_MIN_CONFIDENCE = 0.2


@dataclass(frozen=True)
class Features:
    """What a signal may learn from: the five feature tables plus the declared feature kinds."""

    interactions: DataFrame
    popularity: DataFrame
    recency: DataFrame
    users: DataFrame
    items: DataFrame
    reference: datetime | date
    specs: Sequence[FeatureSpec] = ()
    interaction_type: InteractionType = InteractionType.EXPLICIT

    @staticmethod
    def of(dataset: Dataset, reference: datetime | date, keep: bool = False) -> Features:
        """Aggregate a dataset on the fly, without a feature store.

        With ``keep`` the interactions are written to the shared folder first; worth it when several
        signals read them and they come out of a join.
        """
        rows = dataset.interactions
        if keep:
            rows = durable(rows, "interactions")
        return Features(
            rows,
            aggregates.popularity(rows),
            aggregates.recency(rows, reference),
            dataset.users,
            dataset.items,
            reference,
            tuple(dataset.specs),
            dataset.interaction_type,
        )

    def specs_for(self, applies: Applies) -> list[FeatureSpec] | None:
        """Declared kinds for users or items; None (encode every column) when nothing is declared."""
        return [s for s in self.specs if s.applies is applies] if self.specs else None


@dataclass(frozen=True)
class Artifacts:
    tables: Mapping[str, DataFrame] = field(default_factory=dict)
    models: Mapping[str, Any] = field(default_factory=dict)
    settings: Mapping[str, Any] = field(default_factory=dict)


    def kept(self) -> Artifacts:
        """The same artifacts with every table written out, so that scoring does not repeat the fit."""
        return replace(self, tables={n: durable(t, n) for n, t in self.tables.items()})


@dataclass(frozen=True)
class Signal:
    name: str
    fit: Callable[[Features, Mapping[str, Any]], Artifacts]
    score: Callable[[Artifacts, DataFrame, DataFrame, str], Scores | DenseScores]


def fit_popularity(features: Features, params: Mapping[str, Any]) -> Artifacts:
    return Artifacts({"popularity": features.popularity})


def score_popularity(
    art: Artifacts, users: DataFrame, candidates: DataFrame, method: str = MINMAX
) -> Scores:
    raw = art.tables["popularity"].select(ITEM_ID, F.col("count").alias(RAW_SCORE))
    return item_scores("popularity", raw, candidates, method)


def fit_trends(features: Features, params: Mapping[str, Any]) -> Artifacts:
    """The stored recency table, or a fresh one when another half-life is asked for."""
    halflife = float(params.get("halflife_days", DEFAULT_HALFLIFE_DAYS))
    if halflife == DEFAULT_HALFLIFE_DAYS:
        return Artifacts({"recency": features.recency})
    return Artifacts(
        {"recency": aggregates.recency(features.interactions, features.reference, halflife)}
    )


def score_trends(
    art: Artifacts, users: DataFrame, candidates: DataFrame, method: str = MINMAX
) -> Scores:
    raw = art.tables["recency"].select(ITEM_ID, F.col("recency_score").alias(RAW_SCORE))
    return item_scores("trends", raw, candidates, method)


def assign_clusters(vectors: Vectors, k: int = DEFAULT_CLUSTERS, seed: int = SEED):
    """``(model, DataFrame[user_id, cluster])``."""
    points = vectors.table.select(USER_ID, array_to_vector("features").alias("features"))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(points)
    return model, model.transform(points).select(USER_ID, "cluster")


def fit_segments(features: Features, params: Mapping[str, Any]) -> Artifacts:
    """K-means over user features, then item preferences per cluster.

    ``assignments`` (user_id, cluster) in ``params`` replaces the clustering.
    """
    given = params.get("assignments")
    models: dict[str, Any] = {}
    k = int(params.get("k", DEFAULT_CLUSTERS))
    if given is None:
        vectors = vectorize(
            features.users,
            USER_ID,
            features.specs_for(Applies.USER),
            include_text=bool(params.get("include_text", False)),
        )
        models["kmeans"], given = assign_clusters(vectors, k)
    preferences = aggregates.cluster_preferences(features.interactions, given)
    return Artifacts(
        {"user_clusters": given, "cluster_preferences": preferences}, models, {"k": k}
    )


def score_segments(
    art: Artifacts, users: DataFrame, candidates: DataFrame, method: str = MINMAX
) -> Scores:
    group = F.col("cluster").cast("string").alias(GROUP)
    members = art.tables["user_clusters"].select(USER_ID, group)
    raw = art.tables["cluster_preferences"].select(
        group, ITEM_ID, F.col("cluster_score").alias(RAW_SCORE)
    )
    keys = members.select(GROUP).distinct()
    return keyed_scores(
        "segments", GROUP_GRAIN, raw, keys, candidates, members=members, method=method
    )


def fit_content(features: Features, params: Mapping[str, Any]) -> Artifacts:
    """Unit item vectors and unit user profiles; ``feature_weights`` scales single features."""
    vectors = vectorize(
        features.items,
        ITEM_ID,
        features.specs_for(Applies.ITEM),
        include_text=bool(params.get("include_text", False)),
        weights=params.get("feature_weights"),
        normalize=True,
    )
    profiles = user_profiles(features.interactions, vectors)
    return Artifacts(
        {"item_vectors": vectors.table, "user_profiles": profiles.table},
        settings={"dim": vectors.dim},
    )


def score_content(
    art: Artifacts, users: DataFrame, candidates: DataFrame, method: str = MINMAX
) -> DenseScores:
    return DenseScores(
        "content",
        art.tables["user_profiles"],
        art.tables["item_vectors"],
        int(art.settings["dim"]),
        "zero",
        method,
    )


def fit_als(features: Features, params: Mapping[str, Any]) -> Artifacts:
    """Matrix factorisation.  Ids are indexed before null values are dropped (explicit) or set to 1
    (implicit), so a user with null values only is known to the index but has no factors.

    ``implicit`` follows the kind of the interactions unless it is given."""
    implied = features.interaction_type is InteractionType.IMPLICIT
    implicit = bool(params.get("implicit", implied))
    index = IdIndex.fit(features.interactions)
    rated = features.interactions.select(USER_ID, ITEM_ID, VALUE)
    if implicit:
        rated = rated.withColumn(VALUE, F.coalesce(F.col(VALUE), F.lit(1.0)))
    else:
        rated = with_value(rated)
    rank = int(params.get("rank", DEFAULT_RANK))
    # Every iteration sends a factor to each block that has a rating of it: no more blocks than bound a task's
    # memory.  Factors start from random numbers per block, so the blocks must not depend on the session.
    blocks = max(ALS_BLOCKS, -(-features.interactions.count() // ALS_BLOCK_RATINGS))
    # A checkpoint lets go of the shuffles of the iterations before it.
    ensure_checkpoint_dir(rated.sparkSession)
    als = ALS(
        rank=rank,
        regParam=float(params.get("reg", DEFAULT_REG)),
        maxIter=int(params.get("max_iter", DEFAULT_MAX_ITER)),
        userCol=USER_IDX,
        itemCol=ITEM_IDX,
        ratingCol=VALUE,
        implicitPrefs=implicit,
        coldStartStrategy="drop",
        numUserBlocks=blocks,
        numItemBlocks=blocks,
        checkpointInterval=1,
        seed=SEED,
    )
    ints = index.transform(rated, unknown="drop").select(
        F.col(USER_IDX).cast("int").alias(USER_IDX), F.col(ITEM_IDX).cast("int").alias(ITEM_IDX), VALUE
    )
    model = als.fit(ints)
    return Artifacts(
        {"user_ids": index.users, "item_ids": index.items},
        {"als": model},
        {"implicit": implicit, "dim": rank},
    )


def als_factors(art: Artifacts) -> tuple[DataFrame, DataFrame]:
    """``(user_id, features)`` and ``(item_id, features)`` of a fitted model."""
    model = art.models["als"]

    def named(factors: DataFrame, ids: DataFrame, column: str, idx: str) -> DataFrame:
        return factors.join(ids, F.col("id") == F.col(idx)).select(
            column, F.col("features").cast("array<double>").alias("features")
        )

    return (
        named(model.userFactors, art.tables["user_ids"], USER_ID, USER_IDX),
        named(model.itemFactors, art.tables["item_ids"], ITEM_ID, ITEM_IDX),
    )


def score_als(
    art: Artifacts, users: DataFrame, candidates: DataFrame, method: str = MINMAX
) -> DenseScores:
    users, items = als_factors(art)
    return DenseScores("als_cf", users, items, int(art.settings["dim"]), "drop", method)


def fit_rules(features: Features, params: Mapping[str, Any]) -> Artifacts:
    owned = seen_items(features.interactions)
    rules = params.get("rules")
    if rules is None:
        owned = durable(owned, "owned")
        rules = baskets.mine_rules(
            owned,
            float(params.get("min_support", DEFAULT_MIN_SUPPORT)),
            float(params.get("min_confidence", DEFAULT_MIN_CONFIDENCE)),
        )
    return Artifacts({"rules": rules, "user_items": owned})


def score_rules(
    art: Artifacts, users: DataFrame, candidates: DataFrame, method: str = MINMAX
) -> Scores:
    owned = for_users(art.tables["user_items"], users)
    matched = baskets.matched_confidence(art.tables["rules"], owned)
    # Read for the extremes, for the scores and again by the ranking.
    raw = durable(matched.withColumnRenamed("confidence", RAW_SCORE), "matched")
    keys = owned.select(USER_ID).distinct()
    return keyed_scores("rules", USER_GRAIN, raw, keys, candidates, method=method)


SIGNALS: dict[str, Signal] = {
    s.name: s
    for s in (
        Signal("als_cf", fit_als, score_als),
        Signal("content", fit_content, score_content),
        Signal("popularity", fit_popularity, score_popularity),
        Signal("rules", fit_rules, score_rules),
        Signal("segments", fit_segments, score_segments),
        Signal("trends", fit_trends, score_trends),
    )
}
