"""Event-time results over streams of interactions: windows, late rows, duplicates, sessions, decayed scores.

Times are those of the events.  ``delay`` is how far events may arrive out of order: the watermark is the latest
time seen so far, less the delay.  State is kept until the watermark passes it and survives restarts in the query's
checkpoint.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from datetime import date, datetime, timedelta

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rankweave.functions.scalars import LN2, decay
from rankweave.schema import ITEM_ID, TS, USER_ID
from rankweave.sources.commits import Entries

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DELAY = "1 day"


def run(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append what the stream has to give now to a Parquet folder; a restart goes on where it ended."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()


# -- windows ---------------------------------------------------------------------------------------


def daily_counts(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """``(day, item_id, count)`` of the days that lie behind the watermark, each once and for good."""
    day = F.window(TS, "1 day")
    counts = events.withWatermark(TS, delay).groupBy(day, ITEM_ID).agg(F.count(F.lit(1)).alias("count"))
    return counts.select(F.col("window.start").alias("day"), ITEM_ID, "count")


def deduplicated(events: DataFrame, key: str = "event_id", delay: str = DELAY) -> DataFrame:
    """Events by ``key`` once, whichever batch delivers them again.

    A key is forgotten when the watermark has passed its event; what is delivered again after that is late, and
    dropped as late.
    """
    return events.withWatermark(TS, delay).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = DELAY) -> DataFrame:
    """``(user_id, start, end, events)``: stretches of a user's events less than ``gap`` apart, when the watermark
    has passed their end, the last event plus the gap."""
    found = events.withWatermark(TS, delay).groupBy(F.session_window(TS, gap).alias("s"), USER_ID)
    return found.agg(F.count(F.lit(1)).alias("events")).select(USER_ID, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events")


def sliding_counts(panes: DataFrame, days: int = 30, until: date | None = None) -> DataFrame:
    """``(item_id, day, count)``: events of the ``days`` days that end with ``day``, for every day with any.

    From daily counts: a pane enters the sum on its day and leaves it ``days`` later, so an event is in one pane
    and a pane in two rows, however much the windows overlap.  With ``until`` no later day is given.
    """
    first = F.col("day").cast("date")
    steps = panes.select(
        ITEM_ID, F.explode(F.array(F.struct(first.alias("day"), F.col("count").alias("step")),
                                   F.struct(F.date_add(first, days).alias("day"), (-F.col("count")).alias("step"))))
    ).select(ITEM_ID, "col.*")
    changes = steps.groupBy(ITEM_ID, "day").agg(F.sum("step").alias("step"))
    by_day = W.partitionBy(ITEM_ID).orderBy("day")
    sums = changes.select(ITEM_ID, "day", F.sum("step").over(by_day).alias("count"), F.lead("day").over(by_day).alias("next"))
    last = F.date_sub("next", 1) if until is None else F.least(F.date_sub("next", 1), F.lit(until))
    # The last change of an item takes its sum to 0.
    sums = sums.filter((F.col("count") > 0) & (F.col("day") <= last))
    return sums.select(ITEM_ID, F.explode(F.sequence("day", last)).alias("day"), "count")


# -- late rows -------------------------------------------------------------------------------------


class DailyCounts:
    """Daily counts that keep late rows, where Spark's own windows drop them without a word.

    ``counts/batch=n``       what batch n adds to days that were open, a row per day and item it has.
    ``late/batch=n``         its rows for days that were closed before it.
    ``corrections/batch=n``  what those add to their days.
    ``marks/<n>.json``       the latest event time up to batch n, published last.

    The watermark of a batch comes from the batches before it.  A batch that was not marked is written
    again over its own folders; one that was marked is skipped.
    """

    def __init__(self, root: str, delay: timedelta = timedelta(days=1)):
        self.root, self.delay = root.rstrip("/"), delay

    def _marks(self, spark) -> Entries:
        return Entries(spark, f"{self.root}/marks")

    def watermark(self, spark, before: int | None = None) -> datetime | None:
        """What the batches (``before`` the given one) have reached, None at the beginning."""
        marks = self._marks(spark)
        names = [n for n in marks.names() if before is None or int(n) < before]
        latest = marks.read(names[-1])["latest"] if names else None
        return datetime.fromisoformat(latest) - self.delay if latest else None

    def add(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        marks, name = self._marks(spark), f"{number:012d}"
        if marks.read(name) is not None:
            return
        rows = batch.select(USER_ID, ITEM_ID, "value", TS, F.date_trunc("day", TS).alias("day"))
        rows = rows.persist()
        try:
            mark = self.watermark(spark, number)
            closed = F.lit(False) if mark is None else F.col("day") + F.expr("INTERVAL 1 DAY") <= F.lit(mark)
            count = lambda df: df.groupBy("day", ITEM_ID).agg(F.count(F.lit(1)).alias("count"))
            late = rows.filter(closed)
            for table, df in (("counts", count(rows.filter(~closed))), ("late", late.drop("day")), ("corrections", count(late))):
                df.write.mode("overwrite").parquet(f"{self.root}/{table}/batch={number}")
            latest = rows.agg(F.max(TS)).first()[0]
        finally:
            rows.unpersist()
        before = mark + self.delay if mark else None
        latest = max((t for t in (latest, before) if t), default=None)
        marks.publish(name, {"latest": latest.isoformat() if latest else None})

    def follow(self, events: DataFrame, checkpoint: str) -> None:
        """Add what the stream has to give now."""
        writer = events.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()

    def _table(self, spark, name: str) -> DataFrame:
        done = spark.createDataFrame([(int(n),) for n in self._marks(spark).names()], "batch long").coalesce(1)
        return spark.read.parquet(f"{self.root}/{name}").join(done, "batch", "left_semi").drop("batch")

    def late(self, spark) -> DataFrame:
        return self._table(spark, "late")

    def corrections(self, spark) -> DataFrame:
        return self._table(spark, "corrections").groupBy("day", ITEM_ID).agg(F.sum("count").alias("count"))

    def windows(self, spark) -> DataFrame:
        """``(day, item_id, count, closed)`` as counted in time."""
        counts = self._table(spark, "counts").groupBy("day", ITEM_ID).agg(F.sum("count").alias("count"))
        mark = self.watermark(spark)
        closed = F.lit(False) if mark is None else F.col("day") + F.expr("INTERVAL 1 DAY") <= F.lit(mark)
        return counts.withColumn("closed", closed)

    def corrected(self, spark) -> DataFrame:
        """``(day, item_id, count)`` of all rows, late ones too."""
        every = self.windows(spark).drop("closed").unionByName(self.corrections(spark))
        return every.groupBy("day", ITEM_ID).agg(F.sum("count").alias("count"))


# -- decayed scores --------------------------------------------------------------------------------

_SCORES = f"{ITEM_ID} string, score double, day date"


def _day_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Events of a task by item and day, so that a popular item sends few rows on."""
    for rows in batches:
        yield rows.groupby([ITEM_ID, "day"], as_index=False).agg(n=("n", "sum"))


def decayed_scores(events: DataFrame, halflife_days: float = 30.0) -> DataFrame:
    """``(item_id, score, day)``: a row per item whenever events touch it, the score as of ``day``.

    The state of an item is its score and the latest day of its events.  An event of a later day decays the score to that
    day; one of an earlier day adds its own decayed share.  The newest row of an item gives its score at
    any other day by one factor, so items without events are not written again.
    """
    rate = LN2 / halflife_days

    def touch(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        score, day = state.get if state.exists else (0.0, None)
        for rows in parts:
            for when, n in zip(rows["day"], rows["n"], strict=True):
                if day is None or when > day:
                    score = score * math.exp(-rate * (when - day).days) if day is not None else 0.0
                    day = when
                score += int(n) * math.exp(-rate * (day - when).days)
        state.update((score, day))
        yield pd.DataFrame({ITEM_ID: [key[0]], "score": [score], "day": [day]})

    rows = events.select(ITEM_ID, F.to_date(TS).alias("day"), F.lit(1).cast("bigint").alias("n"))
    rows = rows.mapInPandas(_day_counts, f"{ITEM_ID} string, day date, n bigint")
    return rows.groupBy(ITEM_ID).applyInPandasWithState(touch, _SCORES, "score double, day date", "update", GroupStateTimeout.NoTimeout)


def follow_scores(events: DataFrame, path: str, checkpoint: str, halflife_days: float = 30.0) -> None:
    """Write the touched items of each batch the stream has to give now to ``path/batch=n``."""

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = decayed_scores(events, halflife_days).writeStream.outputMode("update").foreachBatch(add)
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def scores_at(touched: DataFrame, reference: date, halflife_days: float = 30.0) -> DataFrame:
    """``(item_id, recency_score)`` at a day, from the newest row of every item."""
    newest = touched.groupBy(ITEM_ID).agg(F.max_by(F.struct("score", "day"), "batch").alias("s"))
    age: Column = F.datediff(F.lit(reference), F.col("s.day"))
    return newest.select(ITEM_ID, (F.col("s.score") * decay(age, halflife_days)).alias("recency_score"))
