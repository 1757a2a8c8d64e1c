"""The six signals on their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.catalogue.aggregates import MIN_CONFIDENCE, MIN_SUPPORT, RULES
from rankweave.catalogue.common import (
    CLICKS,
    RETAIL,
    by_segment,
    clicks_features,
    retail_features,
    shown,
)
from rankweave.catalogue.features import VECTORS
from rankweave.functions.scaling import MINMAX, ZSCORE, minmax
from rankweave.operators.encode import vectorize
from rankweave.operators.filters import candidates, seen_items
from rankweave.plans.dense import dense_ranges
from rankweave.plans.pairs import score_pairs
from rankweave.plans.scores import GROUP
from rankweave.plans.signals import DEFAULT_REG, SIGNALS, Features, als_factors, assign_clusters
from rankweave.schema import ITEM_ID, SCORE, USER_ID, VALUE, Applies

RULE_PARAMS = {"min_support": MIN_SUPPORT, "min_confidence": MIN_CONFIDENCE}


def scores_of(name: str, features: Features, params=None, method: str = MINMAX):
    signal = SIGNALS[name]
    users = features.users.select(USER_ID)
    art = signal.fit(features, params or {})
    return signal.score(art, users, candidates(features.items), method)


def _listed(scores, *keys: str) -> DataFrame:
    return scores.listed.select(*keys, ITEM_ID, shown(SCORE).alias(SCORE))


def _floor(scores, key: str) -> DataFrame:
    return scores.floor.select(key, shown("floor").alias("floor"))


def signal_popularity(spark: SparkSession, folder: str) -> DataFrame:
    return _listed(scores_of("popularity", retail_features(spark, folder)))


def signal_trends(spark: SparkSession, folder: str) -> DataFrame:
    return _listed(scores_of("trends", retail_features(spark, folder)))


def signal_trends_halflife_90(spark: SparkSession, folder: str) -> DataFrame:
    return _listed(scores_of("trends", retail_features(spark, folder), {"halflife_days": 90}))


def signal_trends_zscore(spark: SparkSession, folder: str) -> DataFrame:
    return _listed(scores_of("trends", retail_features(spark, folder), method=ZSCORE))


def _segments(spark: SparkSession, folder: str):
    features = retail_features(spark, folder)
    return scores_of("segments", features, {"assignments": by_segment(features)})


def signal_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Scores per cluster for a given clustering; every candidate that is not listed has the floor."""
    return _listed(_segments(spark, folder), GROUP)


def signal_segments_floor(spark: SparkSession, folder: str) -> DataFrame:
    return _floor(_segments(spark, folder), GROUP)


def segments_kmeans(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters learned from segment, nation and balance, with their item scores."""
    return _listed(scores_of("segments", retail_features(spark, folder), {"k": 8}), GROUP)


def kmeans_assignments(spark: SparkSession, folder: str) -> DataFrame:
    features = retail_features(spark, folder)
    vectors = vectorize(features.users, USER_ID, features.specs_for(Applies.USER))
    return assign_clusters(vectors, 8)[1]


def _content(spark: SparkSession, folder: str, keep: bool = False):
    features = retail_features(spark, folder, keep)
    return features, scores_of("content", features)


def signal_content_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Smallest and largest cosine of every customer over the whole catalogue."""
    features, dense = _content(spark, folder)
    found = dense_ranges(features.users.select(USER_ID), candidates(features.items), [dense])
    return found.select(USER_ID, "n", shown("lo").alias("lo"), shown("hi").alias("hi"))


def signal_content(spark: SparkSession, folder: str) -> DataFrame:
    """Content score of every pair a customer bought, scaled over the whole catalogue."""
    features, dense = _content(spark, folder, keep=True)
    pairs = seen_items(features.interactions)
    found = score_pairs(pairs, candidates(features.items), [dense])["content"]
    return found.select(USER_ID, ITEM_ID, shown(SCORE).alias(SCORE))


def signal_rules(spark: SparkSession, folder: str) -> DataFrame:
    return _listed(scores_of("rules", clicks_features(spark, folder), RULE_PARAMS), USER_ID)


def signal_rules_floor(spark: SparkSession, folder: str) -> DataFrame:
    return _floor(scores_of("rules", clicks_features(spark, folder), RULE_PARAMS), USER_ID)


def _als(spark: SparkSession, folder: str, implicit: bool) -> DataFrame:
    features = clicks_features(spark, folder)
    dense = scores_of("als_cf", features, {"implicit": implicit})
    pairs = seen_items(features.interactions)
    found = score_pairs(pairs, candidates(features.items), [dense])["als_cf"]
    return found.select(USER_ID, ITEM_ID, SCORE)


def signal_als(spark: SparkSession, folder: str) -> DataFrame:
    """Scaled explicit predictions of every clicked pair."""
    return _als(spark, folder, False)


def signal_als_implicit(spark: SparkSession, folder: str) -> DataFrame:
    return _als(spark, folder, True)


def _als_pairs(spark: SparkSession, folder: str, implicit: bool) -> DataFrame:
    """Whether every clicked pair's score is the product of its factors, scaled between the user's extremes.

    The extremes come from the plan that ``signal_content_ranges`` checks; pairs without factors have no score.
    """
    features = clicks_features(spark, folder, keep=True)
    art = SIGNALS["als_cf"].fit(features, {"implicit": implicit}).kept()
    users, items = als_factors(art)
    pool, pairs = candidates(features.items), seen_items(features.interactions)
    dense = SIGNALS["als_cf"].score(art, features.users.select(USER_ID), pool, MINMAX)
    scored = score_pairs(pairs, pool, [dense])["als_cf"].withColumnRenamed(SCORE, "given")
    rows = pairs.join(users.withColumnRenamed("features", "x"), USER_ID).join(items.withColumnRenamed("features", "v"), ITEM_ID)
    product = F.aggregate(F.zip_with("x", "v", lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p)
    extremes = dense_ranges(users, pool, [dense]).select(USER_ID, "lo", "hi")
    wanted = rows.join(extremes, USER_ID).select(USER_ID, ITEM_ID, minmax(product, F.col("lo"), F.col("hi")).alias("want"))
    both = pairs.join(scored, [USER_ID, ITEM_ID], "left").join(wanted, [USER_ID, ITEM_ID], "left")
    same = F.when(F.col("want").isNull(), F.col("given").isNull()).otherwise(F.abs(F.col("given") - F.col("want")) < 1e-9)
    return both.select(USER_ID, ITEM_ID, F.coalesce(same & (F.col("want").isNull() | F.col("want").between(-1e-9, 1 + 1e-9)), F.lit(False)).alias("same"))


def als_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return _als_pairs(spark, folder, False)


def als_pairs_implicit(spark: SparkSession, folder: str) -> DataFrame:
    return _als_pairs(spark, folder, True)


def kmeans_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """Whether every customer lies in the cluster with the nearest centre."""
    features = retail_features(spark, folder)
    vectors = vectorize(features.users, USER_ID, features.specs_for(Applies.USER))
    model, assigned = assign_clusters(vectors, 8)
    apart = [
        F.aggregate(
            F.zip_with("features", F.array(*[F.lit(float(x)) for x in centre]), lambda a, b: (a - b) * (a - b)),
            F.lit(0.0),
            lambda s, x: s + x,
        )
        for centre in model.clusterCenters()
    ]
    rows = vectors.table.join(assigned, USER_ID).withColumn("d", F.array(*apart))
    return rows.select(USER_ID, (F.get("d", F.col("cluster")) <= F.array_min("d") + 1e-9).alias("nearest"))


def _als_solved(spark: SparkSession, folder: str, implicit: bool) -> DataFrame:
    """Whether a user's factors solve their regularised normal equations, given the item factors.

    The gradient is summed per user and component; it may be a thousandth of the right-hand side.
    """
    features = clicks_features(spark, folder)
    art = SIGNALS["als_cf"].fit(features, {"implicit": implicit})
    users, items = als_factors(art)
    rows = features.interactions.select(USER_ID, ITEM_ID, VALUE)
    rows = rows.fillna(1.0, [VALUE]) if implicit else rows.filter(F.col(VALUE).isNotNull())
    rows = rows.join(users.withColumnRenamed("features", "x"), USER_ID).join(items.withColumnRenamed("features", "v"), ITEM_ID)
    dot = F.aggregate(F.zip_with("x", "v", lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p)
    sure = F.abs(VALUE)
    left = dot * (sure if implicit else F.lit(1.0))
    right = F.when(F.col(VALUE) > 0, 1 + sure).otherwise(0.0) if implicit else F.col(VALUE)
    counts = (F.col(VALUE) > 0).cast("double") if implicit else F.lit(1.0)
    each = rows.select(USER_ID, left.alias("l"), right.alias("r"), counts.alias("n"), F.posexplode("v").alias("k", "c"))
    sums = each.groupBy(USER_ID, "k").agg(
        F.sum(F.col("l") * F.col("c")).alias("l"), F.sum(F.col("r") * F.col("c")).alias("r"), F.sum("n").alias("n")
    )
    mine = users.select(USER_ID, F.posexplode("features").alias("k", "x"))
    sums = sums.join(mine, [USER_ID, "k"])
    if implicit:
        # Every item counts once, seen or not.
        one, two = (items.select(ITEM_ID, F.posexplode("features").alias(k, c)) for k, c in (("k", "a"), ("j", "b")))
        square = one.join(two, ITEM_ID).groupBy("k", "j").agg(F.sum(F.col("a") * F.col("b")).alias("g"))
        all_ = mine.withColumnRenamed("k", "j").join(square, "j").groupBy(USER_ID, "k").agg(F.sum(F.col("g") * F.col("x")).alias("g"))
        sums = sums.join(all_, [USER_ID, "k"]).withColumn("l", F.col("l") + F.col("g"))
    gap = F.col("l") + F.lit(DEFAULT_REG) * F.col("n") * F.col("x") - F.col("r")
    total = sums.groupBy(USER_ID).agg(F.sum(gap * gap).alias("gap"), F.sum(F.col("r") * F.col("r")).alias("size"))
    return total.select(USER_ID, (F.sqrt("gap") <= 1e-3 * F.sqrt("size")).alias("solved"))


def als_solved(spark: SparkSession, folder: str) -> DataFrame:
    return _als_solved(spark, folder, False)


def als_solved_implicit(spark: SparkSession, folder: str) -> DataFrame:
    return _als_solved(spark, folder, True)


QUERIES = {
    "kmeans_nearest": kmeans_nearest,
    "als_pairs": als_pairs,
    "als_pairs_implicit": als_pairs_implicit,
    "als_solved": als_solved,
    "als_solved_implicit": als_solved_implicit,
    "signal_popularity": signal_popularity,
    "signal_trends": signal_trends,
    "signal_trends_halflife_90": signal_trends_halflife_90,
    "signal_trends_zscore": signal_trends_zscore,
    "signal_segments": signal_segments,
    "signal_segments_floor": signal_segments_floor,
    "segments_kmeans": segments_kmeans,
    "kmeans_assignments": kmeans_assignments,
    "signal_content_ranges": signal_content_ranges,
    "signal_content": signal_content,
    "signal_rules": signal_rules,
    "signal_rules_floor": signal_rules_floor,
    "signal_als": signal_als,
    "signal_als_implicit": signal_als_implicit,
}


def trends_sql(name: str, halflife: str = "30.0") -> str:
    return f"""
{name}_raw AS (SELECT item_id, sum(exp(-(0.693147 / {halflife}) * date_diff('day', ts, DATE '2001-08-02'))) x
               FROM ri GROUP BY item_id),
{name}_all AS (SELECT rp.item_id, coalesce(x, 0.0) x FROM rp LEFT JOIN {name}_raw USING (item_id)),
{name} AS (SELECT item_id, CASE WHEN hi = lo THEN 0.5 ELSE (x - lo) / (hi - lo) END score
           FROM {name}_all, (SELECT min(x) lo, max(x) hi FROM {name}_all))"""


POPULARITY = """
pop_all AS (SELECT rp.item_id, CAST(count(user_id) AS DOUBLE) x FROM rp LEFT JOIN ri USING (item_id)
            GROUP BY rp.item_id),
pop AS (SELECT item_id, CASE WHEN hi = lo THEN 0.5 ELSE (x - lo) / (hi - lo) END score
        FROM pop_all, (SELECT min(x) lo, max(x) hi FROM pop_all))"""

# Every cluster with every item; what has no preference has raw score 0.
SEGMENTS = """
seg_pref AS (SELECT segment grp, item_id, avg(value) * count(*) x FROM ri JOIN ru USING (user_id)
             GROUP BY 1, 2),
seg_all AS (SELECT g.grp, rp.item_id, coalesce(x, 0.0) x, x IS NOT NULL AS listed
            FROM (SELECT DISTINCT segment grp FROM ru) g CROSS JOIN rp
            LEFT JOIN seg_pref p ON p.grp = g.grp AND p.item_id = rp.item_id),
seg AS (SELECT grp, item_id, listed,
               CASE WHEN max(x) OVER w = min(x) OVER w THEN 0.5
                    ELSE (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) END score,
               CASE WHEN max(x) OVER w = min(x) OVER w THEN 0.5
                    ELSE (0 - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) END floor
        FROM seg_all WINDOW w AS (PARTITION BY grp))"""

CONTENT = """
con_all AS (SELECT up.user_id, nv.item_id,
                   up.b * nv.b + up.t * nv.t + up.s * nv.s + up.p * nv.p x FROM up CROSS JOIN nv),
con_range AS (SELECT user_id, count(*) n, min(x) lo, max(x) hi FROM con_all GROUP BY user_id),
con AS (SELECT user_id, item_id, CASE WHEN hi = lo THEN 0.5 ELSE (x - lo) / (hi - lo) END score
        FROM con_all JOIN con_range USING (user_id))"""

# Every user with every item; owners of no antecedent have raw score 0 everywhere.
RULE_SCORES = """
met AS (SELECT u, cons i, max(confidence) x FROM bl JOIN rules ON list_has_all(b, ante) GROUP BY 1, 2),
rul_all AS (SELECT a.u user_id, c.i item_id, coalesce(x, 0.0) x, x IS NOT NULL AS listed
            FROM (SELECT DISTINCT u FROM ub) a CROSS JOIN (SELECT DISTINCT i FROM ub) c
            LEFT JOIN met ON met.u = a.u AND met.i = c.i),
rul AS (SELECT user_id, item_id, listed,
               CASE WHEN max(x) OVER w = min(x) OVER w THEN 0.5
                    ELSE (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) END score,
               CASE WHEN max(x) OVER w = min(x) OVER w THEN 0.5
                    ELSE (0 - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) END floor
        FROM rul_all WINDOW w AS (PARTITION BY user_id))"""

ORACLES = {
    "kmeans_nearest": f"WITH {RETAIL} SELECT user_id, true AS nearest FROM ru",
    "als_pairs": f"WITH {CLICKS} SELECT DISTINCT user_id, item_id, true AS same FROM ci",
    "als_pairs_implicit": f"WITH {CLICKS} SELECT DISTINCT user_id, item_id, true AS same FROM ci",
    "als_solved": f"WITH {CLICKS} SELECT DISTINCT user_id, true AS solved FROM ci WHERE value IS NOT NULL",
    "als_solved_implicit": f"WITH {CLICKS} SELECT DISTINCT user_id, true AS solved FROM ci",
    "signal_popularity": f"WITH {RETAIL}, {POPULARITY} SELECT item_id, round(score, 6) score FROM pop",
    "signal_trends": f"WITH {RETAIL}, {trends_sql('tr')} SELECT item_id, round(score, 6) score FROM tr",
    "signal_trends_halflife_90": f"""WITH {RETAIL}, {trends_sql('tr', '90.0')}
        SELECT item_id, round(score, 6) score FROM tr""",
    "signal_trends_zscore": f"""WITH {RETAIL}, {trends_sql('tr')}
        SELECT item_id, round((x - m) / sd, 6) score
        FROM tr_all, (SELECT avg(x) m, stddev_pop(x) sd FROM tr_all)""",
    "signal_segments": f"""WITH {RETAIL}, {SEGMENTS}
        SELECT grp, item_id, round(score, 6) score FROM seg WHERE listed""",
    "signal_segments_floor": f"""WITH {RETAIL}, {SEGMENTS}
        SELECT DISTINCT grp, round(floor, 6) + 0.0 AS floor FROM seg""",
    "signal_content_ranges": f"""WITH {RETAIL}, {VECTORS}, {CONTENT}
        SELECT user_id, n, round(lo, 6) lo, round(hi, 6) hi FROM con_range""",
    "signal_content": f"""WITH {RETAIL}, {VECTORS}, {CONTENT}
        SELECT user_id, item_id, round(score, 6) score
        FROM con SEMI JOIN ri USING (user_id, item_id)""",
    "signal_rules": f"""WITH RECURSIVE {CLICKS}, {RULES}, {RULE_SCORES}
        SELECT user_id, item_id, round(score, 6) score FROM rul WHERE listed""",
    "signal_rules_floor": f"""WITH RECURSIVE {CLICKS}, {RULES}, {RULE_SCORES}
        SELECT DISTINCT user_id, round(floor, 6) + 0.0 AS floor FROM rul""",
}
