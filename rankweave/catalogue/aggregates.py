"""Item aggregates, baskets, rules and splits."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.catalogue.common import CLICKS, RETAIL, by_segment, retail_features, shown
from rankweave.operators import aggregates, baskets, filters, splits
from rankweave.schema import ITEM_ID, TS, USER_ID
from rankweave.sources import tables

# Fixed value: the day that parts old from new interactions in the incremental queries.
CUT = date(2001, 5, 1)

# Rule thresholds for the click data.
MIN_SUPPORT = 0.3
MIN_CONFIDENCE = 0.2


def popularity(spark: SparkSession, folder: str) -> DataFrame:
    return aggregates.popularity(tables.retail_interactions(spark, folder))


def _recency(df: DataFrame) -> DataFrame:
    return df.select(ITEM_ID, shown("recency_score").alias("recency_score"))


def recency(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.retail_interactions(spark, folder)
    return _recency(aggregates.recency(rows, tables.RETAIL_REFERENCE))


def recency_halflife_7(spark: SparkSession, folder: str) -> DataFrame:
    """The reference time lies inside the data: later events weigh more than 1."""
    rows = tables.clicks(spark, folder).interactions
    return _recency(aggregates.recency(rows, datetime(2024, 1, 20, 18, 30), 7.0))


def incremental_popularity(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.retail_interactions(spark, folder)
    old = aggregates.popularity(rows.filter(F.col(TS) < F.lit(CUT)))
    return aggregates.merge_popularity(old, rows.filter(F.col(TS) >= F.lit(CUT)))


def incremental_recency(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.retail_interactions(spark, folder)
    old = aggregates.recency(rows.filter(F.col(TS) < F.lit(CUT)), CUT)
    new = rows.filter(F.col(TS) >= F.lit(CUT))
    return _recency(aggregates.merge_recency(old, CUT, new, tables.RETAIL_REFERENCE))


def cluster_preferences(spark: SparkSession, folder: str) -> DataFrame:
    features = retail_features(spark, folder)
    found = aggregates.cluster_preferences(features.interactions, by_segment(features))
    return found.select("cluster", ITEM_ID, shown("cluster_score").alias("cluster_score"))


def label_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return aggregates.label_frequency(tables.retail(spark, folder).items, "brand")


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    return filters.candidates(tables.retail(spark, folder).items)


def seen_items(spark: SparkSession, folder: str) -> DataFrame:
    return filters.seen_items(tables.retail_interactions(spark, folder))


def seen_by_asked_users(spark: SparkSession, folder: str) -> DataFrame:
    """Seen items of customers with a debt, as a semi join."""
    data = tables.retail(spark, folder)
    asked = data.users.filter(F.col("balance") < 0).select(USER_ID)
    return filters.seen_items(data.interactions, asked)


def exclude_items(spark: SparkSession, folder: str) -> DataFrame:
    items = tables.retail(spark, folder).items
    return filters.candidates(items, ["1", "17", "no such item"])


def exclude_items_table(spark: SparkSession, folder: str) -> DataFrame:
    """A long exclude list: every part of the smallest size."""
    items = tables.retail(spark, folder).items
    return filters.candidates(items, items.filter(F.col("size") == 1).select(ITEM_ID))


def require_features(spark: SparkSession, folder: str) -> DataFrame:
    items = tables.retail(spark, folder).items
    pool = filters.candidates(items)
    return filters.require_features(pool, items, {"type": "SMALL", "size": 7.0})


def basket_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Frequent items per basket; a basket without one stays, empty."""
    owned = filters.seen_items(tables.clicks(spark, folder).interactions)
    return baskets.baskets(owned, MIN_SUPPORT).select(
        USER_ID, F.array_join("items", ",").alias("items"), F.size("items").alias("n")
    )


def frequent_items(spark: SparkSession, folder: str) -> DataFrame:
    owned = filters.seen_items(tables.clicks(spark, folder).interactions)
    return baskets.frequent_items(owned, MIN_SUPPORT)


def association_rules(spark: SparkSession, folder: str) -> DataFrame:
    owned = filters.seen_items(tables.clicks(spark, folder).interactions)
    rules = baskets.mine_rules(owned, MIN_SUPPORT, MIN_CONFIDENCE)
    return rules.select(
        F.array_join(F.sort_array("antecedent"), ",").alias("antecedent"),
        F.array_join("consequent", ",").alias("consequent"),
        shown("confidence").alias("confidence"),
        shown("lift").alias("lift"),
        shown("support").alias("support"),
    )


def matched_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Best confidence per user and consequent over every rule the user's basket meets."""
    owned = filters.seen_items(tables.clicks(spark, folder).interactions)
    rules = baskets.mine_rules(owned, MIN_SUPPORT, MIN_CONFIDENCE)
    met = baskets.matched_confidence(rules, owned)
    return met.select(USER_ID, ITEM_ID, shown("confidence").alias("confidence"))


def split_first_ten_test(spark: SparkSession, folder: str) -> DataFrame:
    return splits.leave_some_out(tables.clicks(spark, folder).interactions, 1, 10)[1]


def split_first_ten_base(spark: SparkSession, folder: str) -> DataFrame:
    return splits.leave_some_out(tables.clicks(spark, folder).interactions, 1, 10)[0]


def split_next_ten_test(spark: SparkSession, folder: str) -> DataFrame:
    return splits.leave_some_out(tables.retail_interactions(spark, folder), 11, 20)[1]


def split_capped_test(spark: SparkSession, folder: str) -> DataFrame:
    """The cap is a feature of the split: the first 500 test rows over all users."""
    return splits.leave_some_out(tables.clicks(spark, folder).interactions, 1, 10, max_test=500)[1]


def split_disjoint(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows base and test hold, and how many distinct rows both hold."""
    rows = tables.clicks(spark, folder).interactions
    base, test = splits.leave_some_out(rows, 1, 10)
    sides = base.withColumn("side", F.lit("base")).unionByName(test.withColumn("side", F.lit("test")))
    counted = sides.groupBy("side").agg(F.count(F.lit(1)).alias("n"))
    both = base.intersect(test).agg(F.lit("both").alias("side"), F.count(F.lit(1)).alias("n"))
    return counted.unionByName(both)


def split_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Contiguous blocks of 2000 rows in time order."""
    return splits.block_folds(tables.clicks(spark, folder).interactions, 2000)


def split_blocks_sizes(spark: SparkSession, folder: str) -> DataFrame:
    folded = splits.block_folds(tables.retail_interactions(spark, folder), 20000)
    return folded.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


def split_hash_folds(spark: SparkSession, folder: str) -> DataFrame:
    """Every row with its fold of five."""
    return splits.hash_folds(tables.retail_interactions(spark, folder), 5)


QUERIES = {
    "popularity": popularity,
    "recency": recency,
    "recency_halflife_7": recency_halflife_7,
    "incremental_popularity": incremental_popularity,
    "incremental_recency": incremental_recency,
    "cluster_preferences": cluster_preferences,
    "label_frequency": label_frequency,
    "candidates": candidates,
    "seen_items": seen_items,
    "seen_by_asked_users": seen_by_asked_users,
    "exclude_items": exclude_items,
    "exclude_items_table": exclude_items_table,
    "require_features": require_features,
    "basket_lists": basket_lists,
    "frequent_items": frequent_items,
    "association_rules": association_rules,
    "matched_rules": matched_rules,
    "split_first_ten_test": split_first_ten_test,
    "split_first_ten_base": split_first_ten_base,
    "split_next_ten_test": split_next_ten_test,
    "split_capped_test": split_capped_test,
    "split_disjoint": split_disjoint,
    "split_blocks": split_blocks,
    "split_blocks_sizes": split_blocks_sizes,
    "split_hash_folds": split_hash_folds,
}

_POPULARITY = f"WITH {RETAIL} SELECT item_id, count(*) AS count FROM ri GROUP BY item_id"
_RECENCY = f"""WITH {RETAIL}
    SELECT item_id,
           round(sum(exp(-(0.693147 / 30.0) * date_diff('day', ts, DATE '2001-08-02'))), 6) AS recency_score
    FROM ri GROUP BY item_id"""

# Frequent item sets of any size, grown item by item together with their owners; every item of a set is
# the consequent of one rule.  Needs WITH RECURSIVE.
RULES = """
ub AS (SELECT DISTINCT user_id u, item_id i FROM ci),
bl AS (SELECT u, list(i) b FROM ub GROUP BY u),
nb AS (SELECT count(*) n, CAST(ceil(0.3 * count(*)) AS BIGINT) least FROM bl),
fi AS (SELECT i, count(*) c, list(u) us FROM ub GROUP BY i HAVING count(*) >= (SELECT least FROM nb)),
grown AS (SELECT [i] s, i last, us FROM fi
          UNION ALL
          SELECT list_append(g.s, f.i), f.i, list_intersect(g.us, f.us)
          FROM grown g JOIN fi f ON f.i > g.last
          WHERE len(list_intersect(g.us, f.us)) >= (SELECT least FROM nb)),
sets AS (SELECT s, len(us) c FROM grown),
split AS (SELECT list_filter(s, lambda e: e <> x) ante, x cons, c
          FROM (SELECT s, unnest(s) x, c FROM sets WHERE len(s) > 1)),
rules AS (SELECT ante, cons, split.c / a.c confidence, (split.c / a.c) / (fi.c / n) lift, split.c / n support
          FROM split JOIN sets a ON a.s = ante JOIN fi ON fi.i = cons, nb WHERE split.c / a.c >= 0.2)"""

_NUMBERED = """
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id, value) r FROM {0})"""

ORACLES = {
    "popularity": _POPULARITY,
    "recency": _RECENCY,
    "recency_halflife_7": f"""WITH {CLICKS}
        SELECT item_id,
               round(sum(exp(-(0.693147 / 7.0) * date_diff('day', ts, DATE '2024-01-20'))), 6) recency_score
        FROM ci GROUP BY item_id""",
    "incremental_popularity": _POPULARITY,
    "incremental_recency": _RECENCY,
    "cluster_preferences": f"""WITH {RETAIL}
        SELECT segment AS cluster, item_id, round(avg(value) * count(*), 6) AS cluster_score
        FROM ri JOIN ru USING (user_id) GROUP BY 1, 2""",
    "label_frequency": f"WITH {RETAIL} SELECT brand AS label, count(*) freq FROM rp GROUP BY 1",
    "candidates": f"WITH {RETAIL} SELECT DISTINCT item_id FROM rp",
    "seen_items": f"WITH {RETAIL} SELECT DISTINCT user_id, item_id FROM ri",
    "seen_by_asked_users": f"""WITH {RETAIL}
        SELECT DISTINCT user_id, item_id FROM ri WHERE user_id IN (SELECT user_id FROM ru WHERE balance < 0)""",
    "exclude_items": f"""WITH {RETAIL}
        SELECT DISTINCT item_id FROM rp WHERE item_id NOT IN ('1', '17', 'no such item')""",
    "exclude_items_table": f"WITH {RETAIL} SELECT DISTINCT item_id FROM rp WHERE size <> 1",
    "require_features": f"WITH {RETAIL} SELECT DISTINCT item_id FROM rp WHERE type = 'SMALL' AND size = 7",
    "basket_lists": f"""WITH RECURSIVE {CLICKS}, {RULES}
        SELECT u AS user_id, coalesce(string_agg(ub.i, ',' ORDER BY ub.i) FILTER (c IS NOT NULL), '') AS items,
               CAST(count(c) AS INTEGER) n
        FROM ub LEFT JOIN fi ON fi.i = ub.i GROUP BY u""",
    "frequent_items": f"WITH RECURSIVE {CLICKS}, {RULES} SELECT i AS item_id, c AS freq FROM fi",
    "association_rules": f"""WITH RECURSIVE {CLICKS}, {RULES}
        SELECT array_to_string(ante, ',') AS antecedent, cons AS consequent,
               round(confidence, 6) AS confidence, round(lift, 6) AS lift, round(support, 6) AS support
        FROM rules""",
    "matched_rules": f"""WITH RECURSIVE {CLICKS}, {RULES}
        SELECT u AS user_id, cons AS item_id, round(max(confidence), 6) AS confidence
        FROM bl JOIN rules ON list_has_all(b, ante) GROUP BY 1, 2""",
    "split_first_ten_test": f"""WITH {CLICKS}, {_NUMBERED.format('ci')}
        SELECT user_id, item_id, value, ts FROM n WHERE r BETWEEN 1 AND 10""",
    "split_first_ten_base": f"""WITH {CLICKS}, {_NUMBERED.format('ci')}
        SELECT user_id, item_id, value, ts FROM n WHERE r > 10""",
    "split_next_ten_test": f"""WITH {RETAIL}, {_NUMBERED.format('ri')}
        SELECT user_id, item_id, value, ts FROM n WHERE r BETWEEN 11 AND 20""",
    "split_capped_test": f"""WITH {CLICKS}, {_NUMBERED.format('ci')}
        SELECT user_id, item_id, value, ts FROM n WHERE r BETWEEN 1 AND 10
        ORDER BY ts, user_id, item_id, value LIMIT 500""",
    "split_disjoint": f"""WITH {CLICKS}, {_NUMBERED.format('ci')},
        b AS (SELECT user_id, item_id, value, ts FROM n WHERE r > 10),
        t AS (SELECT user_id, item_id, value, ts FROM n WHERE r <= 10)
        SELECT 'base' side, count(*) n FROM b UNION ALL SELECT 'test', count(*) FROM t
        UNION ALL SELECT 'both', count(*) FROM (SELECT * FROM b INTERSECT SELECT * FROM t)""",
    "split_blocks": f"""WITH {CLICKS}
        SELECT *, CAST((row_number() OVER (ORDER BY ts, user_id, item_id, value) - 1) // 2000 + 1
                       AS INTEGER) fold FROM ci""",
    "split_blocks_sizes": f"""WITH {RETAIL}
        SELECT fold, count(*) n
        FROM (SELECT CAST((row_number() OVER () - 1) // 20000 + 1 AS INTEGER) fold FROM ri) GROUP BY fold""",
    "split_hash_folds": f"""WITH {RETAIL}
        SELECT *, CAST(CAST('0x' || substr(md5(user_id || '|' || item_id), 1, 8) AS BIGINT) % 5 + 1 AS INTEGER) fold
        FROM ri""",
}
