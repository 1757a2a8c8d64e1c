from __future__ import annotations

import random
from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rankweave.operators import aggregates
from rankweave.schema import INTERACTIONS
from rankweave.sources.commits import Entries
from rankweave.streaming import windows

START = datetime(2026, 3, 1)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def event(user, item, hours):
    return (user, item, 1.0, START + timedelta(hours=hours))


def deliver(spark, folder, rows):
    spark.createDataFrame(rows, INTERACTIONS).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(INTERACTIONS).parquet(folder)


def test_late_rows_correct_closed_days(spark, tmp_path):
    counts, folder = windows.DailyCounts(str(tmp_path / "d")), str(tmp_path / "in")
    rnd, every = random.Random(4), []
    for _ in range(4):
        batch = [event("u", f"i{rnd.randrange(3)}", rnd.randrange(24 * 12)) for _ in range(40)]
        every += batch
        counts.follow(deliver(spark, folder, batch), str(tmp_path / "check"))
    truth = Counter((t.replace(hour=0), i) for _, i, _, t in every)
    assert rows_of(counts.corrected(spark)) == sorted((d, i, n) for (d, i), n in truth.items())
    late = rows_of(counts.late(spark))
    assert late and sum(r["count"] for r in counts.corrections(spark).collect()) == len(late)
    # Each batch is judged by the ones before it.
    mark, want = None, []
    for k in range(4):
        batch = every[40 * k : 40 * k + 40]
        if mark:
            want += [r for r in batch if r[3].replace(hour=0) + timedelta(days=1) <= mark]
        mark = max(r[3] for r in every[: 40 * k + 40]) - timedelta(days=1)
    assert late == sorted(want) and counts.watermark(spark) == mark
    closed = {r["day"] for r in counts.windows(spark).filter("closed").collect()}
    assert closed and all(d + timedelta(days=1) <= mark for d in closed)


def test_a_batch_that_was_cut_short_counts_once(spark, tmp_path):
    counts = windows.DailyCounts(str(tmp_path / "d"))
    batch = spark.createDataFrame([event("u", "a", 1), event("u", "a", 2)], INTERACTIONS)
    publish = Entries.publish
    Entries.publish = lambda *a: 1 / 0
    try:
        with pytest.raises(ZeroDivisionError):
            counts.add(batch, 0)
    finally:
        Entries.publish = publish
    for _ in range(2):
        counts.add(batch, 0)
    counts.add(batch.limit(0), 1)
    assert rows_of(counts.corrected(spark)) == [(START, "a", 2)]
    counts.add(spark.createDataFrame([event("u", "b", 24 * 9)], INTERACTIONS), 2)
    counts.add(batch, 3)
    assert counts.late(spark).count() == 2 and rows_of(counts.corrections(spark)) == [(START, "a", 2)]


def test_windows_close_once(spark, tmp_path):
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for rows in ([event("u", "a", h) for h in (1, 2, 30)], [event("v", "a", 20), event("v", "b", 72)], [event("v", "a", 3)], [event("v", "a", 200)]):
        windows.run(windows.daily_counts(deliver(spark, folder, rows), "1 day"), out, check)
    # The event at hour 3 comes after its day has closed; days 4 to 8 are still open or empty.
    assert rows_of(spark.read.parquet(out)) == [(START, "a", 3), (START + timedelta(days=1), "a", 1), (START + timedelta(days=3), "b", 1)]


def test_keys_are_forgotten_behind_the_watermark(spark, tmp_path):
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "event_id long, ts timestamp"
    kept = []
    for k in range(4):
        rows = [(n, START + timedelta(hours=6 * n)) for n in range(max(0, 20 * k - 5), 20 * k + 20)]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(folder)
        stream = windows.deduplicated(spark.readStream.schema(schema).parquet(folder))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        query.awaitTermination()
        kept.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert rows_of(spark.read.parquet(out).select("event_id")) == [(n,) for n in range(80)]
    # State holds about the events of the delay, not all that were ever seen.
    assert max(kept) <= 25 and kept[-1] <= kept[0] + 5


def test_sessions_merge_across_restarts(spark, tmp_path):
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for hours in ((0, 2, 11), (4, 13), (60,), (100,)):
        windows.run(windows.sessions(deliver(spark, folder, [event("u", "a", h) for h in hours]), "3 hours", "20 hours"), out, check)
    at = lambda h: START + timedelta(hours=h)
    assert rows_of(spark.read.parquet(out)) == [("u", at(0), at(7), 3), ("u", at(11), at(16), 2), ("u", at(60), at(63), 1)]


@pytest.mark.parametrize("days", [1, 3, 30])
def test_sliding_sums(spark, days):
    rnd = random.Random(days)
    panes = {(START + timedelta(days=rnd.randrange(50)), f"i{rnd.randrange(4)}"): rnd.randrange(1, 9) for _ in range(60)}
    df = spark.createDataFrame([(d, i, n) for (d, i), n in panes.items()], "day timestamp, item_id string, count long")
    until = (START + timedelta(days=45)).date()
    want = Counter()
    for (d, i), n in panes.items():
        for k in range(days):
            day = (d + timedelta(days=k)).date()
            if day <= until:
                want[i, day] += n
    assert rows_of(windows.sliding_counts(df, days, until)) == sorted((i, d, n) for (i, d), n in want.items())


def test_sliding_sums_move_panes_not_events(spark):
    panes = spark.createDataFrame([(START, "a", 5)], "day timestamp, item_id string, count long")
    plan = windows.sliding_counts(panes)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and rows_of(windows.sliding_counts(panes).agg(F.count("day"))) == [(30,)]


def test_scores_equal_recency_and_untouched_items_stay(spark, tmp_path):
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    rnd, every = random.Random(8), []
    for k in range(4):
        items = ["a", "b", "c"] if k == 0 else ["a", f"n{k}"]
        batch = [event("u", rnd.choice(items), rnd.randrange(24 * 60)) for _ in range(30)]
        every += batch
        windows.follow_scores(deliver(spark, folder, batch), out, check, 10.0)
    touched = spark.read.parquet(out)
    full = spark.createDataFrame(every, INTERACTIONS)
    for day in (date(2026, 3, 1), date(2026, 5, 9)):
        got, want = (dict(rows_of(x)) for x in (windows.scores_at(touched, day, 10.0), aggregates.recency(full, day, 10.0)))
        assert got == pytest.approx(want, rel=1e-9)
    assert touched.filter("item_id = 'b'").count() == 1 and touched.filter("item_id = 'a'").count() == 4
