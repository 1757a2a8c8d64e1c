from __future__ import annotations

import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from rankweave.functions import scalars, scaling, vectors
from rankweave.plans.heuristics import GENERAL_SIGNALS, Heuristics, SignalConfig
from rankweave.schema import Applies, FeatureKind, FeatureSpec, InteractionType


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_schema_values():
    assert InteractionType("explicit") is InteractionType.EXPLICIT
    assert [k.value for k in FeatureKind] == ["categorical", "numeric", "ordinal", "text"]
    spec = FeatureSpec("age", FeatureKind.NUMERIC, Applies.USER)
    with pytest.raises(AttributeError):
        spec.name = "other"


def test_lenient_int(spark):
    texts = ["3", " 3.0 ", "3.9", "-2.5", "", "x", "nan", "inf", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(scalars.lenient_int(F.col("t"))).collect()]
    assert got == [3, 3, 3, -2, None, None, None, None, None]


def test_dates(spark):
    got = one(
        spark,
        scalars.parse_day(F.lit("05/03/2025")),
        scalars.parse_day(F.lit("2025-03-05")),
        scalars.parse_iso(F.lit("2025-03-05T10:00:00.25+02:00")),
        scalars.parse_iso(F.lit("soon")),
        scalars.epoch_to_timestamp(F.lit(881250949)),
    )
    assert got == (
        datetime(2025, 3, 5),
        None,
        datetime(2025, 3, 5, 8, 0, 0, 250000),
        None,
        datetime(1997, 12, 4, 15, 55, 49),
    )


def test_age_counts_calendar_days(spark):
    days = ["2025-03-09 23:59:59", "2025-03-10 00:00:00", "2025-04-08 12:00:00"]
    df = spark.createDataFrame([(d,) for d in days], "t string").select(
        F.col("t").cast("timestamp").alias("ts")
    )
    age = scalars.age_days(F.col("ts"), date(2025, 3, 10))
    assert [r[0] for r in df.select(age).collect()] == [1, 0, -29]
    weight = [r[0] for r in df.select(scalars.decay(age, 30.0)).collect()]
    assert weight == pytest.approx([math.exp(-0.693147 / 30 * a) for a in (1, 0, -29)])


def test_title_and_flags(spark):
    df = spark.createDataFrame(
        [("Heat (1995)", 0, 1), ("M*A*S*H (1970) (x)", 1, 1), ("unknown", 0, 0)], "t string, a int, b int"
    )
    flags = {"A": F.col("a"), "B": F.col("b")}
    rows = df.select(scalars.title_year(F.col("t")), scalars.first_flag(flags)).collect()
    assert [tuple(r) for r in rows] == [(1995.0, "B"), (1970.0, "A"), (None, "unknown")]


def test_lookup_misses_give_null(spark):
    df = spark.createDataFrame([(1,), (99,), (None,)], "c int")
    got = [r[0] for r in df.select(scalars.lookup(F.col("c"), {1: "one"})).collect()]
    assert got == ["one", None, None]


def test_contains_all(spark):
    rows = [(["a", "b"], ["a"]), (["a"], ["a", "b"]), ([], []), (None, ["a"]), (["a"], None)]
    df = spark.createDataFrame(rows, "basket array<string>, wanted array<string>")
    got = [r[0] for r in df.select(scalars.contains_all(F.col("basket"), F.col("wanted"))).collect()]
    assert got == [True, False, True, False, False]


def test_scaling(spark):
    df = spark.createDataFrame([(2.0,), (4.0,)], "x double")
    lo, hi = F.lit(2.0), F.lit(6.0)
    assert [r[0] for r in df.select(scaling.minmax(F.col("x"), lo, hi)).collect()] == [0.0, 0.5]
    assert one(spark, scaling.minmax(F.lit(2.0), F.lit(2.0), F.lit(2.0)))[0] == 0.5
    assert one(spark, scaling.zscore(F.lit(2.0), F.lit(2.0), F.lit(1e-17), F.lit(2.0), F.lit(2.0)))[0] == 0.0
    assert one(spark, scaling.zscore(F.lit(2.0), F.lit(1.0), F.lit(0.5), F.lit(0.0), F.lit(2.0)))[0] == 2.0
    with pytest.raises(ValueError):
        scaling.scaled(F.lit(1.0), {}, "other")


def test_vectors(spark):
    unit = vectors.unit([F.lit(3.0), F.lit(4.0)])
    zero = vectors.unit([F.lit(0.0), F.lit(0.0)])
    none = F.lit(None).cast("array<double>")
    got = one(spark, unit, zero, vectors.dot(unit, unit, 2), vectors.dot(unit, none, 2))
    assert got[0] == pytest.approx([0.6, 0.8]) and got[1] == [0.0, 0.0]
    assert got[2] == pytest.approx(1.0) and got[3] == 0.0


def test_event_round_trip(spark):
    message = scalars.event_json(
        F.lit("u"), F.lit("i"), F.lit(None).cast("double"), F.lit("2025-01-02 03:04:05").cast("timestamp")
    )
    text = one(spark, message)[0]
    assert '"value":null' in text and "2025-01-02T03:04:05" in text
    back = one(spark, scalars.event_from_json(F.lit(text)), scalars.event_from_json(F.lit("{oops")))
    assert tuple(back[0])[:3] == ("u", "i", None)
    assert back[1] is None or set(back[1]) == {None}


def test_heuristics_checks():
    with pytest.raises(ValueError):
        SignalConfig(1.5)
    with pytest.raises(ValueError):
        Heuristics("d", top_k=0)
    with pytest.raises(ValueError):
        Heuristics("d", normalization="softmax")
    h = Heuristics("d", GENERAL_SIGNALS)
    assert h.top_k == 20 and h.normalization == "minmax" and h.filters.exclude_seen
    assert sorted(h.mixture) == ["als_cf", "content", "popularity", "segments", "trends"]
    assert SignalConfig(0.1, {"k": 3}, {"a": 2.0}).fit_params() == {"k": 3, "feature_weights": {"a": 2.0}}


def test_heuristics_from_settings():
    raw = {
        "domain": "d",
        "signals": {"popularity": {"weight": 0.25}, "als_cf": {"weight": 1, "params": {"rank": 7}}, "rules": {"weight": 0}},
        "filters": {"exclude_items": ["a"]},
    }
    found = Heuristics.read(raw)
    assert (found.top_k, found.normalization, found.filters.exclude_seen, found.filters.exclude_items) == (20, "minmax", True, ["a"])
    assert found.signals["als_cf"].params == {"rank": 7} and found.mixture == {"als_cf": 1, "popularity": 0.25}
    assert Heuristics.read({"domain": "d"}) == Heuristics("d")
    bad = [
        {}, {"domain": "d", "topk": 3}, {"domain": "d", "top_k": 0}, {"domain": "d", "top_k": "3"}, {"domain": "d", "normalization": "l2"},
        {"domain": "d", "signals": ["popularity"]}, {"domain": "d", "signals": {"a": {}}}, {"domain": "d", "signals": {"a": {"weight": 1.5}}},
        {"domain": "d", "signals": {"a": {"weight": 1, "parms": {}}}}, {"domain": "d", "filters": {"seen": True}},
    ]
    for settings in bad:
        with pytest.raises(ValueError):
            Heuristics.read(settings)
