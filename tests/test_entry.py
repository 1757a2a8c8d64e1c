"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest
from oracle import compare, connect

import __spark_entry__ as contract

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="test tables not mounted")


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns[:4] == ["user_id", "rank", "item_id", "final_score"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, con, name):
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert contract.queries()[name](spark, DATA).count() > 0
    else:
        assert compare(spark, con, DATA, contract.queries()[name], sql) is None
