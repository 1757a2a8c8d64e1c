"""Helpers shared by the query modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.plans.signals import Features
from rankweave.schema import Dataset
from rankweave.sources import tables

# Doubles are compared at this many decimals.
SHOWN = 6

# The canonical views as SQL, to be put in front of an oracle query.
RETAIL = """
ri AS (SELECT CAST(o_custkey AS VARCHAR) user_id, CAST(l_partkey AS VARCHAR) item_id,
              CAST(l_quantity AS DOUBLE) value, CAST(o_orderdate AS TIMESTAMP) ts
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
ru AS (SELECT CAST(c_custkey AS VARCHAR) user_id, c_mktsegment segment, n_name nation,
              CAST(c_acctbal AS DOUBLE) balance
       FROM customer JOIN nation ON c_nationkey = n_nationkey),
rp AS (SELECT CAST(p_partkey AS VARCHAR) item_id, p_brand brand, p_type type,
              CAST(p_size AS DOUBLE) size, CAST(p_retailprice AS DOUBLE) price
       FROM part)"""
CLICKS = """
ci AS (SELECT CAST(user_id AS VARCHAR) user_id, json_extract_string(props, '$.k') item_id,
              CAST(value AS DOUBLE) value, CAST(ts AS TIMESTAMP) ts
       FROM events)"""
VOTES = """
vi AS (SELECT CAST(c_custkey AS VARCHAR) user_id, c_mktsegment item_id, 1.0::DOUBLE value,
              TIMESTAMP '2024-01-01 00:00:00' ts
       FROM customer
       WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')),
vu AS (SELECT CAST(c_custkey AS VARCHAR) user_id, CAST(c_nationkey AS VARCHAR) district FROM customer),
vp AS (SELECT unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']) item_id)"""


def shown(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    # Adding 0.0 turns a negative zero into a plain one.
    return F.round(column, SHOWN) + F.lit(0.0)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[shown(f.name).alias(f.name) if f.dataType.typeName() == "double" else f.name for f in df.schema])


def retail(spark: SparkSession, folder: str) -> Dataset:
    return tables.retail(spark, folder)


def retail_features(spark: SparkSession, folder: str, keep: bool = False) -> Features:
    return Features.of(tables.retail(spark, folder), tables.RETAIL_REFERENCE, keep)


def clicks_features(spark: SparkSession, folder: str, keep: bool = False) -> Features:
    return Features.of(tables.clicks(spark, folder), tables.CLICKS_REFERENCE, keep)


def votes_features(spark: SparkSession, folder: str, keep: bool = False) -> Features:
    return Features.of(tables.votes(spark, folder), tables.CLICKS_REFERENCE, keep)


def by_segment(features: Features) -> DataFrame:
    """A given assignment of retail customers: their market segment is the cluster."""
    return features.users.select("user_id", F.col("segment").alias("cluster"))
