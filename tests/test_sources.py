from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F

from rankweave.schema import ITEM_ID, USER_ID
from rankweave.sources import delimited, events, synthetic

CANONICAL = ["user_id", "item_id", "value", "ts"]


def write(folder, name, text, encoding="utf-8"):
    path = folder / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_movie_files(spark, tmp_path):
    ratings = write(tmp_path, "ratings.tsv", "196\t242\t3\t881250949\n186\t302\t4\t891717742\n")
    people = write(tmp_path, "people.psv", "1|24|M|technician|85711\n2|53|F|other|94043\n")
    flags = {"Comedy": "1|Two Mén (1995)", "none": "2|unknown"}
    lines = []
    for genre, head in flags.items():
        bits = "|".join("1" if g == genre else "0" for g in delimited.GENRES)
        lines.append(f"{head}|01-Jan-1995||http://x|{bits}")
    titles = write(tmp_path, "titles.psv", "\n".join(lines) + "\n", "iso-8859-1")
    data = delimited.movies(spark, ratings, people, titles)
    first = data.interactions.orderBy(F.col(USER_ID).desc()).first()
    assert tuple(first) == ("196", "242", 3.0, datetime(1997, 12, 4, 15, 55, 49))
    assert data.interactions.columns == CANONICAL
    assert [tuple(r) for r in data.users.orderBy(USER_ID).collect()] == [
        ("1", 24.0, "M", "technician"),
        ("2", 53.0, "F", "other"),
    ]
    a, b = data.items.orderBy(ITEM_ID).collect()
    assert (a["title"], a["year"], a["primary_genre"], a["genre_Comedy"]) == ("Two Mén (1995)", 1995.0, "Comedy", 1.0)
    assert (b["year"], b["primary_genre"]) == (None, "unknown")
    assert len([c for c in data.items.columns if c.startswith("genre_")]) == 19
    assert len(data.specs) == 24


def test_survey_file(spark, tmp_path):
    head = "resp_id,v104,date,agegroup,gender,educ,religiosity,sector,District_CBS,other\n"
    body = (
        "1,2,05/03/2025,3,1,2,1,1,4,x\n"
        "2,13.0,not a day,3,1,,1,1,4,x\n"
        "3,98,05/03/2025,3,1,2,1,1,4,x\n"
        "4,,05/03/2025,3,1,2,1,1,4,x\n"
        "5,abc,05/03/2025,3,1,2,1,1,4,x\n"
        ",1,05/03/2025,3,1,2,1,1,4,x\n"
    )
    data = delimited.elections(spark, write(tmp_path, "s.csv", "﻿" + head + body))
    assert [tuple(r) for r in data.interactions.orderBy(USER_ID).collect()] == [
        ("1", "YeshAtid", 1.0, datetime(2025, 3, 5)),
        ("2", "Balad", 1.0, None),
    ]
    assert data.users.columns[0] == USER_ID and data.users.columns[-1] == "district"
    assert data.users.filter(F.col(USER_ID) == "2").first()["educ"] is None
    assert data.items.count() == 13


def test_rating_lines(spark):
    lines = spark.createDataFrame(
        [("1\t2\t3\t881250949",), ("1\t2\t3",), ("1\t2\tbad\t5",), ("",)], "value string"
    )
    good, bad = delimited.rating_lines(lines)
    assert [tuple(r) for r in good.collect()] == [("1", "2", 3.0, datetime(1997, 12, 4, 15, 55, 49))]
    assert sorted(r["fields"] for r in bad.collect()) == [1, 3, 4]


def test_synthetic_is_reproducible_and_in_range(spark):
    data = synthetic.synthetic(spark, 50, 20, 1000, seed=7)
    again = synthetic.synthetic(spark, 50, 20, 1000, seed=7)
    other = synthetic.synthetic(spark, 50, 20, 1000, seed=8)
    assert data.interactions.columns == CANONICAL
    assert data.interactions.count() == 1000 and data.users.count() == 50 and data.items.count() == 20
    assert data.interactions.exceptAll(again.interactions).count() == 0
    assert data.interactions.exceptAll(other.interactions).count() > 0
    stats = data.interactions.agg(F.min("value"), F.max("value"), F.min("ts"), F.max("ts")).first()
    assert stats[0] == 1.0 and stats[1] == 5.0
    assert stats[2] >= datetime(2025, 6, 1) and stats[3] <= datetime(2026, 6, 1)
    assert {r[0] for r in data.users.select("age_group").distinct().collect()} == set(synthetic.AGE_GROUPS)
    assert data.items.filter(~F.col("quality_score").between(0, 10)).count() == 0
    assert len(data.specs) == 4


def test_messages(spark):
    texts = [
        '{"user_id":"u","item_id":"i","value":2,"ts":"2025-01-01T00:00:00"}',
        '{"user_id":"u","item_id":"i","ts":"2025-01-01T00:00:00.5+02:00"}',
        '{"user_id":"","item_id":"i","ts":"2025-01-01T00:00:00"}',
        '{"user_id":"u","ts":"2025-01-01T00:00:00"}',
        '{"user_id":"u","item_id":"i","value":"many","ts":"2025-01-01T00:00:00"}',
        '{"user_id":"u","item_id":"i","ts":"soon"}',
        '{"user_id":"u","item_id":"i"}',
        "{broken",
    ]
    df = spark.createDataFrame([(t.encode(),) for t in texts], "value binary")
    good, bad = events.validated(events.from_messages(df))
    assert [(r["value"], r["ts"]) for r in good.collect()] == [
        (2.0, datetime(2025, 1, 1)),
        (None, datetime(2024, 12, 31, 22, 0, 0, 500000)),
        (None, datetime(2025, 1, 1)),
    ]
    assert [r["reason"] for r in bad.collect()] == ["user_id", "item_id", "ts", "ts", "user_id"]
    assert bad.filter(F.col("message") == "{broken").count() == 1
    lenient, refused = events.validated(events.from_messages(df), default_time=True)
    assert lenient.count() == 4 and refused.filter(F.col("reason") == "ts").count() == 1


def test_bodies(spark, tmp_path):
    event = {"user_id": "u", "item_id": "i", "value": 1.5}
    write(tmp_path, "a.json", json.dumps({"interactions": [event, {**event, "ts": "2025-01-01T00:00:00Z"}]}, indent=1))
    write(tmp_path, "b.json", json.dumps({"interactions": []}))
    rows, refused = events.body_events(events.read_bodies(spark, str(tmp_path)))
    assert rows.count() == 2 and [r["events"] for r in refused.collect()] == [0]
    many = spark.range(1).select(
        F.array_repeat(F.struct(F.lit("u").alias("user_id"), F.lit("i").alias("item_id"), F.lit(1.0).alias("value"), F.lit(None).cast("string").alias("ts")), events.MAX_BATCH + 1).alias("interactions")
    )
    rows, refused = events.body_events(many)
    assert rows.count() == 0 and refused.first()["events"] == events.MAX_BATCH + 1


def test_export_and_replay(spark, tmp_path):
    data = synthetic.interactions(spark, 5, 5, 30)
    events.export_json(data, str(tmp_path / "out"))
    events.replay(data, "text", path=str(tmp_path / "topic"))
    for folder in ("out", "topic"):
        back, bad = events.validated(events.from_messages(spark.read.text(str(tmp_path / folder))))
        assert bad.count() == 0 and back.exceptAll(data).count() == 0 and back.count() == 30


def test_replay_and_export_count(spark, tmp_path):
    data = synthetic.synthetic(spark, 5, 4, 37).interactions
    assert events.export_json(data, str(tmp_path / "a")) == 37 == spark.read.text(str(tmp_path / "a")).count()
    assert [events.replay(data, "text", path=str(tmp_path / "b")) for _ in range(2)] == [37, 37]
    assert spark.read.text(str(tmp_path / "b")).count() == 74
    assert events.export_json(data.limit(0), str(tmp_path / "c")) == 0
