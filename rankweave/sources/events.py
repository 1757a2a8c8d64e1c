"""Interactions as JSON: messages on a stream, batch bodies, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.functions.scalars import event_from_json, event_json, parse_iso
from rankweave.schema import EVENT, ITEM_ID, TS, USER_ID, VALUE

# Fixed value: a batch body may hold this many events.
MAX_BATCH = 100_000

BODY = T.StructType([T.StructField("interactions", T.ArrayType(EVENT))])


def to_messages(interactions: DataFrame) -> DataFrame:
    """One JSON message per row in column ``value``."""
    return interactions.select(
        event_json(F.col(USER_ID), F.col(ITEM_ID), F.col(VALUE), F.col(TS)).alias("value")
    )


def from_messages(messages: DataFrame, column: str = "value") -> DataFrame:
    """Messages (string or bytes) to ``message`` plus the four event fields, ``ts`` still as text."""
    return messages.select(
        F.col(column).cast("string").alias("message"), event_from_json(F.col(column)).alias("_event")
    ).select("message", "_event.*")


def complaint(default_time: bool = False) -> Column:
    """Why an event cannot be stored, null when it can.

    With ``default_time`` a missing ``ts`` is fine (it becomes the time of arrival); a ``ts`` that does
    not parse never is.
    """
    bad_time = parse_iso(F.col(TS)).isNull()
    if default_time:
        bad_time = bad_time & F.col(TS).isNotNull()
    return (
        F.when(F.col(USER_ID).isNull() | (F.length(USER_ID) == 0), F.lit("user_id"))
        .when(F.col(ITEM_ID).isNull() | (F.length(ITEM_ID) == 0), F.lit("item_id"))
        .when(bad_time, F.lit("ts"))
    )


def validated(events: DataFrame, default_time: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(interactions, rejects)``; rejects keep their columns and get ``reason``."""
    judged = events.withColumn("reason", complaint(default_time))
    when = parse_iso(F.col(TS))
    if default_time:
        when = F.coalesce(when, F.current_timestamp())
    good = judged.filter(F.col("reason").isNull()).select(
        USER_ID, ITEM_ID, F.col(VALUE).cast("double").alias(VALUE), when.alias(TS)
    )
    return good, judged.filter(F.col("reason").isNotNull())


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Files that each hold one ``{"interactions": [...]}`` body."""
    return spark.read.schema(BODY).json(path, multiLine=True)


def parse_bodies(bodies: DataFrame, column: str = "value") -> DataFrame:
    return bodies.select(F.from_json(F.col(column), BODY).alias("_b")).select("_b.*")


def body_events(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(events, refused bodies)``: bodies with 1 to ``MAX_BATCH`` events are unfolded."""
    size = F.coalesce(F.size("interactions"), F.lit(0))
    fine = size.between(1, MAX_BATCH)
    events = bodies.filter(fine).select(F.explode("interactions").alias("_e")).select("_e.*")
    return events, bodies.filter(~fine).select(size.alias("events"))


def _counted(messages: DataFrame) -> tuple[DataFrame, Observation]:
    """The rows as they are, and what counts them as they are written."""
    seen = Observation("events")
    return messages.observe(seen, F.count(F.lit(1)).alias("n")), seen


def export_json(interactions: DataFrame, path: str) -> int:
    """JSON lines, one interaction each, written by the executors; how many."""
    messages, seen = _counted(to_messages(interactions))
    messages.write.mode("overwrite").text(path)
    return seen.get["n"]


def replay(interactions: DataFrame, fmt: str = "kafka", **options: str) -> int:
    """Write every interaction as a message, keyed by user, to Kafka or any other sink with a value
    column, and return how many.  For Kafka give ``kafka.bootstrap.servers`` and ``topic``."""
    messages = to_messages(interactions)
    if fmt == "kafka":
        messages = interactions.select(
            F.col(USER_ID).alias("key"),
            event_json(F.col(USER_ID), F.col(ITEM_ID), F.col(VALUE), F.col(TS)).alias("value"),
        )
    messages, seen = _counted(messages)
    messages.write.format(fmt).mode("append").options(**options).save()
    return seen.get["n"]


def kafka_stream(spark: SparkSession, servers: str, topic: str = "interactions") -> DataFrame:
    """Message stream from the earliest offset; needs Spark's Kafka package on the class path."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .load()
        .select("value")
    )


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """Message stream from a folder of text files, one JSON message per line."""
    return spark.readStream.text(path)
