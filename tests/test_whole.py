"""Queries that hand on a ranking only: a signal that cannot be learned is an error, not a ranking without it."""

from __future__ import annotations

import json
from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rankweave import catalogue
from rankweave.plans.signals import SIGNALS, Artifacts

DAY = datetime(2000, 1, 1)


@pytest.fixture
def shop(spark, tmp_path):
    """Nine customers with an order of three of eight parts each, and as many clicks."""
    bought = [(u, (u + 3 * j) % 8) for u in range(9) for j in range(3)]
    tables = {
        "nation": ([(1, "A")], "n_nationkey int, n_name string"),
        "customer": (
            [(u, 1, float(u), f"S{u % 2}") for u in range(9)],
            "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string",
        ),
        "part": (
            [(i, f"B{i % 3}", f"T{i % 2}", i, 10.0 + i) for i in range(8)],
            "p_partkey long, p_brand string, p_type string, p_size int, p_retailprice double",
        ),
        "orders": ([(u, u, DAY) for u in range(9)], "o_orderkey long, o_custkey long, o_orderdate timestamp"),
        "lineitem": ([(u, i, 1.0 + i) for u, i in bought], "l_orderkey long, l_partkey long, l_quantity double"),
        "events": (
            [(DAY, u, 1.0, json.dumps({"k": f"i{i}"})) for u, i in bought],
            "ts timestamp, user_id long, value double, props string",
        ),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def _early(features, params):
    raise ArithmeticError("not learned")


def _late(features, params):
    """Fails when its table is written."""
    return Artifacts({"x": features.items.select(F.raise_error(F.lit("not learned")).alias("x"))})


LOST = [
    ("recommend_all_signals", "als_cf"),
    ("recommend_breakdown", "segments"),
    ("recommend_rules", "rules"),
    ("recommend_segments", "segments"),
    ("recommend_sql_signals", "content"),
]


@pytest.mark.parametrize("fit", [_early, _late])
@pytest.mark.parametrize("name, signal", LOST)
def test_a_lost_signal_is_an_error(spark, shop, monkeypatch, name, signal, fit):
    monkeypatch.setitem(SIGNALS, signal, replace(SIGNALS[signal], fit=fit))
    with pytest.raises(Exception, match="not learned"):
        print(name, signal, "rows:", catalogue.QUERIES[name](spark, shop).count())
