"""Combination, filters, top-k and whole recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankweave.catalogue.aggregates import RULES
from rankweave.catalogue.common import (
    CLICKS,
    RETAIL,
    VOTES,
    by_segment,
    clicks_features,
    retail_features,
    rounded,
    votes_features,
)
from rankweave.catalogue.features import VECTORS
from rankweave.catalogue.signals import (
    CONTENT,
    POPULARITY,
    RULE_PARAMS,
    RULE_SCORES,
    SEGMENTS,
    trends_sql,
)
from rankweave.operators import filters
from rankweave.operators.filters import Filters
from rankweave.operators.numbering import durable
from rankweave.plans.combine import (
    combine_full_outer,
    combine_union,
    top_k_per_user,
    top_k_single,
)
from rankweave.plans.heuristics import GENERAL_SIGNALS, SURVEY_TOP_K, Heuristics, SignalConfig
from rankweave.plans.pairs import glued_pairs
from rankweave.plans.recommend import fit_all, recommend, score_all
from rankweave.plans.signals import Features
from rankweave.schema import BREAKDOWN, ITEM_ID, USER_ID

# Baskets that have to hold a rule: three, and more where customers are few and buy much of the same.
RULE_BASKETS, RULE_ROOM = 3, 900


def _all_six(features: Features) -> dict[str, SignalConfig]:
    """The general mixture with rules that this many customers really have."""
    users = max(1, features.users.count())
    support = max(RULE_BASKETS, RULE_ROOM // users) / users
    return {**GENERAL_SIGNALS, "rules": SignalConfig(0.2, {"min_support": support, "min_confidence": 0.05})}


def _ranked(features: Features, heuristics: Heuristics) -> DataFrame:
    """Maps cannot be compared; the contributions stay as columns."""
    found = recommend(features, features.users.select(USER_ID), heuristics)
    return rounded(found.drop(BREAKDOWN))


def recommend_popularity(spark: SparkSession, folder: str) -> DataFrame:
    features = retail_features(spark, folder, keep=True)
    return _ranked(features, Heuristics("retail", {"popularity": SignalConfig(1.0)}))


def recommend_popularity_trends(spark: SparkSession, folder: str) -> DataFrame:
    """Seen items stay, excluded and unfitting ones go."""
    signals = {"popularity": SignalConfig(0.4), "trends": SignalConfig(0.6)}
    chosen = Filters(exclude_seen=False, exclude_items=["1", "17"], require_features={"type": "SMALL"})
    return _ranked(
        retail_features(spark, folder, keep=True), Heuristics("retail", signals, top_k=10, filters=chosen)
    )


def recommend_segments(spark: SparkSession, folder: str) -> DataFrame:
    features = retail_features(spark, folder, keep=True)
    signals = {
        "popularity": SignalConfig(0.3),
        "segments": SignalConfig(0.7, {"assignments": by_segment(features)}),
    }
    return _ranked(features, Heuristics("retail", signals))


def recommend_content(spark: SparkSession, folder: str) -> DataFrame:
    signals = {"content": SignalConfig(1.0)}
    return _ranked(retail_features(spark, folder, keep=True), Heuristics("retail", signals))


def recommend_sql_signals(spark: SparkSession, folder: str) -> DataFrame:
    features = retail_features(spark, folder, keep=True)
    signals = {
        "popularity": SignalConfig(0.1),
        "content": SignalConfig(0.2),
        "segments": SignalConfig(0.1, {"assignments": by_segment(features)}),
        "trends": SignalConfig(0.1),
    }
    return _ranked(features, Heuristics("retail", signals))


def recommend_rules(spark: SparkSession, folder: str) -> DataFrame:
    signals = {"popularity": SignalConfig(0.25), "rules": SignalConfig(0.75, RULE_PARAMS)}
    return _ranked(clicks_features(spark, folder, keep=True), Heuristics("clicks", signals, top_k=10))


def recommend_votes(spark: SparkSession, folder: str) -> DataFrame:
    """Survey mixture: the chosen option stays in the ranking."""
    features = votes_features(spark, folder, keep=True)
    given = features.users.select(USER_ID, F.col("district").alias("cluster"))
    signals = {
        "popularity": SignalConfig(0.3),
        "segments": SignalConfig(0.7, {"assignments": given}),
    }
    chosen = Filters(exclude_seen=False)
    return _ranked(features, Heuristics("votes", signals, top_k=SURVEY_TOP_K, filters=chosen))


def recommend_all_signals(spark: SparkSession, folder: str) -> DataFrame:
    """All six signals with learned clusters, factors and rules."""
    features = retail_features(spark, folder, keep=True)
    return _ranked(features, Heuristics("retail", _all_six(features)))


def recommend_all_signals_checked(spark: SparkSession, folder: str) -> DataFrame:
    """What has to hold for every user's ranking of all six signals, none of which may be skipped.

    ``rules`` says that rules were found and tell some user's items apart, the same for all rows.
    """
    features = retail_features(spark, folder, keep=True)
    heuristics = Heuristics("retail", _all_six(features))
    fitted = fit_all(features, heuristics, strict=True)
    learned = not fitted.artifacts["rules"].tables["rules"].isEmpty()
    found = durable(recommend(features, features.users.select(USER_ID), heuristics, fitted), "found")
    parts = F.aggregate(F.map_values(BREAKDOWN), F.lit(0.0), lambda s, x: s + x)
    seen = filters.seen_items(features.interactions).withColumn("seen", F.lit(True))
    apart = found.groupBy(USER_ID).agg((F.max("c_rules") > F.min("c_rules")).alias("apart"))
    ruled = F.lit(learned and not apart.filter("apart").isEmpty())
    before = F.lag("final_score").over(W.partitionBy(USER_ID).orderBy("rank"))
    rows = found.join(seen, [USER_ID, ITEM_ID], "left").withColumn("before", before)
    return rows.groupBy(USER_ID).agg(
        ((F.count(F.lit(1)) == 20) & (F.max("rank") == 20) & (F.count_distinct("rank") == 20)).alias("ranks"),
        F.every(F.coalesce(F.col("before") >= F.col("final_score"), F.lit(True))).alias("falling"),
        F.every(F.abs(parts - F.col("final_score")) < 1e-9).alias("parts"),
        F.every(F.col("seen").isNull()).alias("unseen"),
        F.every(ruled).alias("rules"),
    )


def recommend_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    """The breakdown as text, signals in order of name, cold ones left out."""
    features = retail_features(spark, folder, keep=True)
    signals = {
        "popularity": SignalConfig(0.3),
        "segments": SignalConfig(0.7, {"assignments": by_segment(features)}),
    }
    found = recommend(features, features.users.select(USER_ID), Heuristics("retail", signals, top_k=5))
    entries = F.transform(
        F.array_sort(F.map_entries(BREAKDOWN)), lambda e: F.concat_ws("=", e["key"], F.format_number(e["value"], 6))
    )
    return found.select(USER_ID, "rank", ITEM_ID, F.array_join(entries, ",").alias("parts"))


def recommend_als(spark: SparkSession, folder: str) -> DataFrame:
    signals = {"als_cf": SignalConfig(1.0), "popularity": SignalConfig(0.1)}
    return _ranked(clicks_features(spark, folder, keep=True), Heuristics("clicks", signals))


WEIGHTS = {"popularity": 0.1, "trends": 0.3, "segments": 0.6}


def _glued(spark: SparkSession, folder: str, glue) -> DataFrame:
    features = retail_features(spark, folder, keep=True)
    signals = {
        "popularity": SignalConfig(0.1),
        "segments": SignalConfig(0.6, {"assignments": by_segment(features)}),
        "trends": SignalConfig(0.3),
    }
    fitted = fit_all(features, Heuristics("retail", signals), strict=True)
    # Every signal joins the candidates.
    users, items = features.users.select(USER_ID), durable(filters.candidates(features.items), "candidates")
    scores = score_all(fitted, users, items)
    return rounded(glued_pairs(filters.seen_items(features.interactions), items, scores, WEIGHTS, glue))


def combine_pairs_full_outer(spark: SparkSession, folder: str) -> DataFrame:
    """Breakdown of every bought pair, signal frames glued by full outer joins."""
    return _glued(spark, folder, combine_full_outer)


def combine_pairs_union(spark: SparkSession, folder: str) -> DataFrame:
    return _glued(spark, folder, combine_union)


def exclude_seen(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs bought before 2001 that were not bought again since."""
    rows = retail_features(spark, folder).interactions
    cut = F.lit("2001-01-01").cast("timestamp")
    old = filters.seen_items(rows.filter(F.col("ts") < cut))
    return filters.exclude_seen(old, filters.seen_items(rows.filter(F.col("ts") >= cut)))


def apply_filters(spark: SparkSession, folder: str) -> DataFrame:
    features = retail_features(spark, folder)
    cut = F.lit("2001-01-01").cast("timestamp")
    rows = features.interactions
    chosen = Filters(True, ["5", "6", "7"], {"type": "PROMO"})
    return filters.apply_filters(
        filters.seen_items(rows.filter(F.col("ts") < cut)),
        chosen,
        filters.seen_items(rows.filter(F.col("ts") >= cut)),
        features.items,
    )


def topk_per_user(spark: SparkSession, folder: str) -> DataFrame:
    """Five best bought parts per customer by total quantity; ties go to the smaller id."""
    totals = (
        retail_features(spark, folder)
        .interactions.groupBy(USER_ID, ITEM_ID)
        .agg(F.sum("value").alias("final_score"))
    )
    return top_k_per_user(totals, 5)


def topk_single(spark: SparkSession, folder: str) -> DataFrame:
    totals = (
        retail_features(spark, folder)
        .interactions.groupBy(ITEM_ID)
        .agg(F.sum("value").alias("final_score"))
    )
    return top_k_single(totals, 20)


QUERIES = {
    "recommend_popularity": recommend_popularity,
    "recommend_popularity_trends": recommend_popularity_trends,
    "recommend_segments": recommend_segments,
    "recommend_content": recommend_content,
    "recommend_sql_signals": recommend_sql_signals,
    "recommend_rules": recommend_rules,
    "recommend_votes": recommend_votes,
    "recommend_all_signals": recommend_all_signals,
    "recommend_all_signals_checked": recommend_all_signals_checked,
    "recommend_breakdown": recommend_breakdown,
    "recommend_als": recommend_als,
    "combine_full_outer": combine_pairs_full_outer,
    "combine_union": combine_pairs_union,
    "exclude_seen": exclude_seen,
    "apply_filters": apply_filters,
    "topk_per_user": topk_per_user,
    "topk_single": topk_single,
}

_TRENDS = trends_sql("tr")


def _ranked_sql(
    views: str, parts: dict[str, str], frame: str, k: int, ids: str = "user_id, item_id"
) -> str:
    """``frame`` gives the ids and one score per signal; ``parts`` maps signal to ``weight * score``,
    null where the signal is cold."""
    columns = ", ".join(f"round({expr}, 14) AS c_{name}" for name, expr in parts.items())
    total = " + ".join(f"coalesce(c_{name}, 0.0)" for name in parts)
    shown = ", ".join(f"round(c_{name}, 6) AS c_{name}" for name in parts)
    return f"""WITH RECURSIVE {views},
        contributions AS (SELECT {ids}, {columns} {frame}),
        summed AS (SELECT *, round({total}, 14) AS total FROM contributions),
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY total DESC, item_id)
                                  AS INTEGER) AS rank FROM summed)
        SELECT user_id, rank, item_id, round(total, 6) AS final_score, {shown}
        FROM ranked WHERE rank <= {k}"""


_UNSEEN = "NOT EXISTS (SELECT 1 FROM ri WHERE ri.user_id = a.user_id AND ri.item_id = b.item_id)"
_VOTE_SCORES = """
vpop_all AS (SELECT vp.item_id, CAST(count(user_id) AS DOUBLE) x FROM vp LEFT JOIN vi USING (item_id)
             GROUP BY vp.item_id),
vpop AS (SELECT item_id, CASE WHEN hi = lo THEN 0.5 ELSE (x - lo) / (hi - lo) END score
         FROM vpop_all, (SELECT min(x) lo, max(x) hi FROM vpop_all)),
vseg_pref AS (SELECT district grp, item_id, avg(value) * count(*) x FROM vi JOIN vu USING (user_id)
              GROUP BY 1, 2),
vseg_all AS (SELECT g.grp, vp.item_id, coalesce(x, 0.0) x
             FROM (SELECT DISTINCT district grp FROM vu) g CROSS JOIN vp
             LEFT JOIN vseg_pref p ON p.grp = g.grp AND p.item_id = vp.item_id),
vseg AS (SELECT grp, item_id,
                CASE WHEN max(x) OVER w = min(x) OVER w THEN 0.5
                     ELSE (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) END score
         FROM vseg_all WINDOW w AS (PARTITION BY grp))"""
_CLICK_POPULARITY = """
cpop_all AS (SELECT item_id, CAST(count(*) AS DOUBLE) x FROM ci GROUP BY item_id),
cpop AS (SELECT item_id, CASE WHEN hi = lo THEN 0.5 ELSE (x - lo) / (hi - lo) END score
         FROM cpop_all, (SELECT min(x) lo, max(x) hi FROM cpop_all))"""
_PAIRS = f"""WITH {RETAIL}, {POPULARITY}, {_TRENDS}, {SEGMENTS},
    c AS (SELECT i.user_id, i.item_id, round(0.1 * pop.score, 14) c_popularity,
                 round(0.3 * tr.score, 14) c_trends, round(0.6 * seg.score, 14) c_segments
          FROM (SELECT DISTINCT user_id, item_id FROM ri) i JOIN ru USING (user_id)
          JOIN pop ON pop.item_id = i.item_id JOIN tr ON tr.item_id = i.item_id
          JOIN seg ON seg.grp = ru.segment AND seg.item_id = i.item_id)
    SELECT user_id, item_id, round(c_popularity, 6) c_popularity, round(c_trends, 6) c_trends,
           round(c_segments, 6) c_segments, round(c_popularity + c_trends + c_segments, 6) final_score FROM c"""
_OLD = """
old AS (SELECT DISTINCT user_id, item_id FROM ri WHERE ts < TIMESTAMP '2001-01-01'),
new AS (SELECT DISTINCT user_id, item_id FROM ri WHERE ts >= TIMESTAMP '2001-01-01')"""

ORACLES = {
    "recommend_all_signals_checked": f"""WITH {RETAIL}
        SELECT user_id, true AS ranks, true AS falling, true AS parts, true AS unseen, true AS rules FROM ru""",
    "recommend_breakdown": "SELECT user_id, rank, item_id, printf('popularity=%.6f,segments=%.6f', c_popularity, "
    "c_segments) AS parts FROM ("
    + _ranked_sql(
        f"{RETAIL}, {POPULARITY}, {SEGMENTS}",
        {"popularity": "0.3 * pop.score", "segments": "0.7 * b.score"},
        f"FROM ru a JOIN seg b ON b.grp = a.segment JOIN pop USING (item_id) WHERE {_UNSEEN}",
        5,
    )
    + ")",
    "recommend_popularity": _ranked_sql(
        f"{RETAIL}, {POPULARITY}",
        {"popularity": "b.score"},
        f"FROM ru a CROSS JOIN pop b WHERE {_UNSEEN}",
        20,
    ),
    "recommend_popularity_trends": _ranked_sql(
        f"{RETAIL}, {POPULARITY}, {_TRENDS}",
        {"popularity": "0.4 * pop.score", "trends": "0.6 * tr.score"},
        """FROM ru a CROSS JOIN pop JOIN tr USING (item_id) JOIN rp USING (item_id)
           WHERE rp.type = 'SMALL' AND item_id NOT IN ('1', '17')""",
        10,
    ),
    "recommend_segments": _ranked_sql(
        f"{RETAIL}, {POPULARITY}, {SEGMENTS}",
        {"popularity": "0.3 * pop.score", "segments": "0.7 * b.score"},
        f"FROM ru a JOIN seg b ON b.grp = a.segment JOIN pop USING (item_id) WHERE {_UNSEEN}",
        20,
    ),
    "recommend_content": _ranked_sql(
        f"{RETAIL}, {VECTORS}, {CONTENT}",
        {"content": "b.score"},
        f"FROM ru a JOIN con b USING (user_id) WHERE {_UNSEEN}",
        20,
    ),
    # Customers without orders have no profile: their content contribution is null.
    "recommend_sql_signals": _ranked_sql(
        f"{RETAIL}, {POPULARITY}, {_TRENDS}, {SEGMENTS}, {VECTORS}, {CONTENT}",
        {
            "content": "0.2 * con.score",
            "popularity": "0.1 * pop.score",
            "segments": "0.1 * b.score",
            "trends": "0.1 * tr.score",
        },
        f"""FROM ru a JOIN seg b ON b.grp = a.segment JOIN pop USING (item_id) JOIN tr USING (item_id)
            LEFT JOIN con ON con.user_id = a.user_id AND con.item_id = b.item_id WHERE {_UNSEEN}""",
        20,
        "a.user_id, b.item_id",
    ),
    "recommend_rules": _ranked_sql(
        f"{CLICKS}, {_CLICK_POPULARITY}, {RULES}, {RULE_SCORES}",
        {"popularity": "0.25 * cpop.score", "rules": "0.75 * rul.score"},
        "FROM rul JOIN cpop USING (item_id) ANTI JOIN ci USING (user_id, item_id)",
        10,
    ),
    "recommend_votes": _ranked_sql(
        f"{VOTES}, {_VOTE_SCORES}",
        {"popularity": "0.3 * vpop.score", "segments": "0.7 * vseg.score"},
        "FROM vu JOIN vseg ON vseg.grp = vu.district JOIN vpop USING (item_id)",
        10,
    ),
    "combine_full_outer": _PAIRS,
    "combine_union": _PAIRS,
    "exclude_seen": f"WITH {RETAIL}, {_OLD} SELECT * FROM old ANTI JOIN new USING (user_id, item_id)",
    "apply_filters": f"""WITH {RETAIL}, {_OLD}
        SELECT * FROM old ANTI JOIN new USING (user_id, item_id)
        WHERE item_id NOT IN ('5', '6', '7')
          AND item_id IN (SELECT item_id FROM rp WHERE type = 'PROMO')""",
    "topk_per_user": f"""WITH {RETAIL},
        t AS (SELECT user_id, item_id, sum(value) final_score FROM ri GROUP BY 1, 2)
        SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id
                                      ORDER BY final_score DESC, item_id) AS INTEGER) AS rank FROM t)
        WHERE rank <= 5""",
    "topk_single": f"""WITH {RETAIL}
        SELECT item_id, sum(value) final_score FROM ri GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
}
