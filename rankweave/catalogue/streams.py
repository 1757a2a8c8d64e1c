"""Event-time results over the click events, delivered in three rounds with a restart before each."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.catalogue.common import CLICKS, shown
from rankweave.operators.numbering import scratch
from rankweave.schema import ITEM_ID, TS, USER_ID
from rankweave.sources import tables
from rankweave.streaming import windows

ROUNDS = 3
GAP = "8 hours"


def _events(spark: SparkSession, folder: str) -> DataFrame:
    event = tables.table(spark, folder, "events").select("event_id", F.col("ts").cast("timestamp").alias(TS), "user_id", "value", "props")
    item = F.get_json_object("props", "$.k")
    return event.select("event_id", F.col("user_id").cast("string").alias(USER_ID), item.alias(ITEM_ID), F.col("value").cast("double").alias("value"), TS)


def _third(events: DataFrame) -> Column:
    """0, 1 or 2: which third of the time an event lies in."""
    first, last = events.agg(F.min(TS).cast("double"), F.max(TS).cast("double")).first()
    place = (F.col(TS).cast("double") - F.lit(first)) * ROUNDS / F.lit(max(last - first, 1.0))
    return F.least(F.floor(place), F.lit(ROUNDS - 1))


def _shuffled(events: DataFrame) -> Column:
    return F.col("event_id") % ROUNDS


def _delivered(events: DataFrame, root: str, turn: Column, again: bool = False) -> Iterator[DataFrame]:
    """The stream after each round of delivery; with ``again`` a round brings the one before once more."""
    spark, path = events.sparkSession, f"{root}/in"
    turned = events.withColumn("turn", turn)
    for k in range(ROUNDS):
        here = F.col("turn").isin(k, k - 1) if again else F.col("turn") == k
        turned.filter(here).drop("turn").write.mode("append").parquet(path)
        yield spark.readStream.schema(events.schema).parquet(path)


def daily_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Counts per item of the days the watermark has passed."""
    events, root = _events(spark, folder), scratch(spark, "windows")
    for stream in _delivered(events, root, _third(events)):
        windows.run(windows.daily_counts(stream), f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out")


def _late_counts(spark: SparkSession, folder: str) -> windows.DailyCounts:
    events, root = _events(spark, folder), scratch(spark, "late")
    counts = windows.DailyCounts(root)
    for stream in _delivered(events, root, _shuffled(events)):
        counts.follow(stream.drop("event_id"), f"{root}/checkpoint")
    return counts


def late_corrections(spark: SparkSession, folder: str) -> DataFrame:
    """Counts per item and day of events out of order: what came in time and what corrects closed days."""
    counts = _late_counts(spark, folder)
    mine = counts.windows(spark).select("day", ITEM_ID, F.col("count").alias("in_time"))
    both = mine.join(counts.corrections(spark).withColumnRenamed("count", "late"), ["day", ITEM_ID], "full")
    return both.select("day", ITEM_ID, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("in_time", "late")])


def events_once(spark: SparkSession, folder: str) -> DataFrame:
    """Events per item of a stream that delivers two thirds of them twice, in different batches."""
    events, root = _events(spark, folder), scratch(spark, "once")
    for stream in _delivered(events, root, _third(events), again=True):
        windows.run(windows.deduplicated(stream), f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out").groupBy(ITEM_ID).agg(F.count(F.lit(1)).alias("count"))


def user_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of users that the watermark has passed."""
    events, root = _events(spark, folder), scratch(spark, "sessions")
    for stream in _delivered(events, root, _third(events)):
        windows.run(windows.sessions(stream, GAP), f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out")


def sliding_month(spark: SparkSession, folder: str) -> DataFrame:
    """Events per item of the 30 days up to every day, from daily counts kept by a stream."""
    panes = _late_counts(spark, folder).corrected(spark)
    found = windows.sliding_counts(panes, 30, date(2024, 2, 10))
    return found.select(ITEM_ID, F.col("day").cast("timestamp").alias("day"), "count")


def decayed_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Recency of items kept as state, events out of order."""
    events, root = _events(spark, folder), scratch(spark, "decayed")
    for stream in _delivered(events, root, _shuffled(events)):
        windows.follow_scores(stream, f"{root}/out", f"{root}/checkpoint")
    found = windows.scores_at(spark.read.parquet(f"{root}/out"), tables.CLICKS_REFERENCE)
    return found.select(ITEM_ID, shown("recency_score").alias("recency_score"))


QUERIES = {
    "daily_windows": daily_windows,
    "late_corrections": late_corrections,
    "events_once": events_once,
    "user_sessions": user_sessions,
    "sliding_month": sliding_month,
    "decayed_stream": decayed_stream,
}

# The watermark: the latest event less a day, in whole milliseconds.
_MARK = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY FROM ci)"
ORACLES = {
    "daily_windows": f"""WITH {CLICKS}
        SELECT * FROM (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, item_id, count(*) AS count FROM ci GROUP BY 1, 2)
        WHERE day + INTERVAL 1 DAY <= {_MARK}""",
    # A round's watermark comes from the rounds before it.
    "late_corrections": f"""WITH e AS (
            SELECT json_extract_string(props, '$.k') item_id, CAST(ts AS TIMESTAMP) ts, event_id % {ROUNDS} turn FROM events),
        m AS (SELECT t.turn, max(ts) - INTERVAL 1 DAY mark FROM range({ROUNDS}) t(turn) LEFT JOIN e ON e.turn < t.turn GROUP BY t.turn)
        SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, item_id,
               count(*) FILTER (mark IS NULL OR date_trunc('day', ts) + INTERVAL 1 DAY > mark) AS in_time,
               count(*) FILTER (date_trunc('day', ts) + INTERVAL 1 DAY <= mark) AS late
        FROM e JOIN m USING (turn) GROUP BY ALL""",
    "events_once": f"WITH {CLICKS} SELECT item_id, count(*) AS count FROM ci GROUP BY item_id",
    "user_sessions": f"""WITH {CLICKS},
        starts AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL {GAP} THEN 0 ELSE 1 END fresh FROM ci
                   WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        numbered AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) n FROM starts)
        SELECT user_id, min(ts) AS start, max(ts) + INTERVAL {GAP} AS "end", count(*) AS events FROM numbered
        GROUP BY user_id, n HAVING "end" <= {_MARK}""",
    "sliding_month": f"""WITH {CLICKS}
        SELECT item_id, CAST(d AS TIMESTAMP) AS day, count(*) AS count
        FROM ci JOIN (SELECT CAST(unnest(generate_series(TIMESTAMP '2023-12-01', TIMESTAMP '2024-02-10', INTERVAL 1 DAY)) AS DATE) d)
          ON CAST(ts AS DATE) BETWEEN d - 29 AND d GROUP BY item_id, d""",
    "decayed_stream": f"""WITH {CLICKS}
        SELECT item_id, round(sum(exp(-(0.693147 / 30.0) * date_diff('day', ts, DATE '2024-02-01'))), 6) AS recency_score
        FROM ci GROUP BY item_id""",
}
