"""Canonical views, projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.catalogue.common import CLICKS, RETAIL, VOTES, shown
from rankweave.functions import scalars
from rankweave.operators import aggregates, filters
from rankweave.schema import ITEM_ID, TS, USER_ID, VALUE
from rankweave.sources import events, tables
from rankweave.sources.delimited import rating_lines


def canonical_retail(spark: SparkSession, folder: str) -> DataFrame:
    return tables.retail(spark, folder).interactions


def canonical_clicks(spark: SparkSession, folder: str) -> DataFrame:
    return tables.clicks(spark, folder).interactions


def canonical_votes(spark: SparkSession, folder: str) -> DataFrame:
    return tables.votes(spark, folder).interactions


def feature_projection_users(spark: SparkSession, folder: str) -> DataFrame:
    return tables.retail(spark, folder).users


def feature_projection_items(spark: SparkSession, folder: str) -> DataFrame:
    return tables.retail(spark, folder).items


def catalog_votes(spark: SparkSession, folder: str) -> DataFrame:
    """Every option of the literal catalogue with its number of votes, unchosen ones with 0."""
    data = tables.votes(spark, folder)
    counts = aggregates.popularity(data.interactions)
    return data.items.join(counts, ITEM_ID, "left").select(
        ITEM_ID, F.coalesce("count", F.lit(0)).alias("votes")
    )


# Names of the codes 1 to 4; every other code is no choice.
REGION_CODES = {1: "west", 2: "east", 3: "north", 4: "south"}


def code_lookup_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Survey style: codes written as text, sometimes with decimals or blanks or as words, are parsed
    leniently, kept when they name an option and translated."""
    key = F.col("c_custkey")
    text = (
        F.when(key % 7 == 0, F.lit(""))
        .when(key % 7 == 1, F.concat(F.lit(" "), F.col("c_nationkey"), F.lit(".0")))
        .when(key % 7 == 2, F.concat(F.col("c_nationkey"), F.lit(".9 ")))
        .when(key % 7 == 3, F.lit("n/a"))
        .otherwise(F.col("c_nationkey").cast("string"))
    )
    code = scalars.lenient_int(F.col("answer"))
    return (
        tables.table(spark, folder, "customer")
        .select(key.cast("string").alias(USER_ID), text.alias("answer"))
        .withColumn("code", code)
        .filter(F.col("code").isin(list(REGION_CODES)))
        .select(USER_ID, "code", scalars.lookup(F.col("code"), REGION_CODES).alias(ITEM_ID))
    )


def epoch_and_day(spark: SparkSession, folder: str) -> DataFrame:
    """Order times as epoch seconds and as day text, both parsed back; cancelled days do not parse."""
    orders = tables.table(spark, folder, "orders")
    when = F.col("o_orderdate").cast("timestamp")
    raw = orders.select(
        "o_orderkey",
        F.unix_timestamp(when).alias("epoch"),
        F.when(F.col("o_orderstatus") == "P", F.lit("31/02/2001"))
        .otherwise(F.date_format(when, scalars.DAY_FORMAT))
        .alias("day"),
        F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss.SSS'+02:00'").alias("iso"),
    )
    return raw.select(
        "o_orderkey",
        scalars.epoch_to_timestamp(F.col("epoch")).alias("from_epoch"),
        scalars.parse_day(F.col("day")).alias("from_day"),
        scalars.parse_iso(F.col("iso")).alias("from_iso"),
    )


def title_scalars(spark: SparkSession, folder: str) -> DataFrame:
    """Year out of a title, blank to null, and the first set flag as label."""
    part = tables.table(spark, folder, "part")
    title = F.when(F.col("p_size") % 10 == 0, F.col("p_name")).otherwise(
        F.concat("p_name", F.lit(" ("), F.col("p_size") + 1950, F.lit(")"))
    )
    flags = {
        n: F.when(F.col("p_type") == n, 1).otherwise(0) for n in ("ECONOMY", "PROMO", "SMALL")
    }
    blank = F.when(F.col("p_size") < 5, F.lit("")).otherwise(F.col("p_size").cast("string"))
    return part.select(
        F.col("p_partkey").cast("string").alias(ITEM_ID),
        scalars.title_year(title).alias("year"),
        scalars.first_flag(flags).alias("label"),
        scalars.to_double(blank).alias("size"),
    )


def age_and_decay(spark: SparkSession, folder: str) -> DataFrame:
    """Calendar-day age and decay weight of every click; the reference lies inside the month, so some
    ages are negative and weigh more than 1."""
    from datetime import date

    age = scalars.age_days(F.col(TS), date(2024, 1, 15))
    return tables.clicks(spark, folder).interactions.select(
        USER_ID, ITEM_ID, TS, age.alias("age"), shown(scalars.decay(age, 7.0)).alias("weight")
    )


def event_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Clicks to JSON messages and back; every third message is damaged and comes back as nulls."""
    clicks = tables.table(spark, folder, "events").select(
        "event_id",
        scalars.event_json(
            F.col("user_id").cast("string"),
            F.get_json_object("props", "$.k"),
            F.when(F.col("event_type") == "error", F.lit(None)).otherwise(F.col("value")),
            F.col("ts").cast("timestamp"),
        ).alias("json"),
    )
    damaged = F.when(F.col("event_id") % 3 == 0, F.substring("json", 1, 20)).otherwise(F.col("json"))
    back = events.from_messages(clicks.select(damaged.alias("value")))
    good, _ = events.validated(back)
    return good


def rejected_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Why messages are refused: counts per reason over clicks with planted faults."""
    fault = F.col("event_id") % 10
    raw = tables.table(spark, folder, "events").select(
        F.when(fault == 1, F.lit("")).otherwise(F.col("user_id").cast("string")).alias(USER_ID),
        F.when(fault == 2, F.lit(None)).otherwise(F.get_json_object("props", "$.k")).alias(ITEM_ID),
        F.col("value").alias(VALUE),
        F.when(fault == 3, F.lit("yesterday"))
        .otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"))
        .alias(TS),
    )
    messages = raw.select(F.to_json(F.struct("*")).alias("value"))
    _, bad = events.validated(events.from_messages(messages))
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def batch_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """One request body per order, unfolded to rows; missing times are allowed and not shown."""
    lines = tables.table(spark, folder, "lineitem")
    one = F.struct(
        F.col("l_suppkey").cast("string").alias(USER_ID),
        F.col("l_partkey").cast("string").alias(ITEM_ID),
        F.col("l_quantity").alias(VALUE),
    )
    bodies = lines.groupBy("l_orderkey").agg(
        F.to_json(F.struct(F.collect_list(one).alias("interactions"))).alias("value")
    )
    unfolded, _ = events.body_events(events.parse_bodies(bodies))
    good, _ = events.validated(unfolded, default_time=True)
    return good.select(USER_ID, ITEM_ID, VALUE)


def rating_file_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Tab-separated rating lines mixed with whole documents; documents are no ratings."""
    clicks = tables.clicks(spark, folder).interactions
    lines = clicks.select(
        F.concat_ws(
            "\t", USER_ID, ITEM_ID, F.col(VALUE).cast("string"), F.unix_timestamp(TS).cast("string")
        ).alias("value")
    )
    other = tables.table(spark, folder, "documents").select(F.col("text").alias("value"))
    good, _ = rating_lines(lines.unionByName(other))
    return good


def rating_file_rejects(spark: SparkSession, folder: str) -> DataFrame:
    other = tables.table(spark, folder, "documents").select(F.col("text").alias("value"))
    _, bad = rating_lines(other)
    return bad.groupBy("fields").agg(F.count(F.lit(1)).alias("n"))


def value_not_null(spark: SparkSession, folder: str) -> DataFrame:
    """Explicit ratings only: errors carry no value and drop out."""
    clicks = tables.table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias(USER_ID),
        F.get_json_object("props", "$.k").alias(ITEM_ID),
        F.when(F.col("event_type") != "error", F.col("value")).alias(VALUE),
    )
    return filters.with_value(clicks)


QUERIES = {
    "canonical_retail": canonical_retail,
    "canonical_clicks": canonical_clicks,
    "canonical_votes": canonical_votes,
    "feature_projection_users": feature_projection_users,
    "feature_projection_items": feature_projection_items,
    "catalog_votes": catalog_votes,
    "code_lookup_filter": code_lookup_filter,
    "epoch_and_day": epoch_and_day,
    "title_scalars": title_scalars,
    "age_and_decay": age_and_decay,
    "event_messages": event_messages,
    "rejected_messages": rejected_messages,
    "batch_bodies": batch_bodies,
    "rating_file_lines": rating_file_lines,
    "rating_file_rejects": rating_file_rejects,
    "value_not_null": value_not_null,
}

ORACLES = {
    "canonical_retail": f"WITH {RETAIL} SELECT * FROM ri",
    "canonical_clicks": f"WITH {CLICKS} SELECT * FROM ci",
    "canonical_votes": f"WITH {VOTES} SELECT * FROM vi",
    "feature_projection_users": f"WITH {RETAIL} SELECT * FROM ru",
    "feature_projection_items": f"WITH {RETAIL} SELECT * FROM rp",
    "catalog_votes": f"""WITH {VOTES}
        SELECT item_id, count(user_id) AS votes FROM vp LEFT JOIN vi USING (item_id) GROUP BY item_id""",
    "code_lookup_filter": """
        WITH a AS (
          SELECT CAST(c_custkey AS VARCHAR) user_id,
                 CASE c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN ' ' || c_nationkey || '.0'
                   WHEN 2 THEN c_nationkey || '.9 ' WHEN 3 THEN 'n/a'
                   ELSE CAST(c_nationkey AS VARCHAR) END answer
          FROM customer),
        b AS (SELECT user_id, CAST(trunc(try_cast(trim(answer) AS DOUBLE)) AS INTEGER) code FROM a)
        SELECT user_id, code,
               CASE code WHEN 1 THEN 'west' WHEN 2 THEN 'east' WHEN 3 THEN 'north' ELSE 'south' END item_id
        FROM b WHERE code IN (1, 2, 3, 4)""",
    "epoch_and_day": """
        SELECT o_orderkey, date_trunc('second', CAST(o_orderdate AS TIMESTAMP)) from_epoch,
               CASE WHEN o_orderstatus <> 'P'
                    THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END from_day,
               date_trunc('millisecond', CAST(o_orderdate AS TIMESTAMP)) - INTERVAL 2 HOUR from_iso
        FROM orders""",
    "title_scalars": """
        WITH a AS (
          SELECT p_partkey, p_type, p_size,
                 CASE WHEN p_size % 10 = 0 THEN p_name ELSE p_name || ' (' || (p_size + 1950) || ')' END t
          FROM part)
        SELECT CAST(p_partkey AS VARCHAR) item_id,
               try_cast(nullif(regexp_extract(t, '\\((\\d{4})\\)', 1), '') AS DOUBLE) AS year,
               CASE WHEN p_type IN ('ECONOMY', 'PROMO', 'SMALL') THEN p_type ELSE 'unknown' END AS label,
               CASE WHEN p_size >= 5 THEN CAST(p_size AS DOUBLE) END AS size
        FROM a""",
    "age_and_decay": f"""WITH {CLICKS}
        SELECT user_id, item_id, ts, CAST(date_diff('day', ts, DATE '2024-01-15') AS INTEGER) AS age,
               round(exp(-(0.693147 / 7.0) * date_diff('day', ts, DATE '2024-01-15')), 6) AS weight
        FROM ci""",
    "event_messages": """
        SELECT CAST(user_id AS VARCHAR) user_id, json_extract_string(props, '$.k') item_id,
               CASE WHEN event_type <> 'error' THEN value END AS value, CAST(ts AS TIMESTAMP) ts
        FROM events WHERE event_id % 3 <> 0""",
    "rejected_messages": """
        SELECT CASE event_id % 10 WHEN 1 THEN 'user_id' WHEN 2 THEN 'item_id' ELSE 'ts' END reason,
               count(*) n
        FROM events WHERE event_id % 10 IN (1, 2, 3) GROUP BY 1""",
    "batch_bodies": """
        SELECT CAST(l_suppkey AS VARCHAR) user_id, CAST(l_partkey AS VARCHAR) item_id,
               l_quantity AS value FROM lineitem""",
    "rating_file_lines": f"""WITH {CLICKS}
        SELECT user_id, item_id, value, date_trunc('second', ts) ts FROM ci""",
    "rating_file_rejects": """
        SELECT CAST(len(string_split(text, chr(9))) AS INTEGER) AS fields, count(*) n
        FROM documents GROUP BY 1""",
    "value_not_null": """
        SELECT CAST(user_id AS VARCHAR) user_id, json_extract_string(props, '$.k') item_id, value
        FROM events WHERE event_type <> 'error' AND value IS NOT NULL""",
}
