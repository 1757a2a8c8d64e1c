"""Train/test splits of an interaction table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankweave.operators.numbering import number_rows
from rankweave.schema import ITEM_ID, TS, USER_ID, VALUE

# A table has no file order; this total order (up to equal rows) stands in for it.
ORDER = (TS, USER_ID, ITEM_ID, VALUE)


def leave_some_out(
    interactions: DataFrame,
    start: int,
    stop: int,
    max_test: int = 0,
    order: Sequence[str] = ORDER,
) -> tuple[DataFrame, DataFrame]:
    """``(base, test)``: the ``start``-th to ``stop``-th row of every user is test, the rest base.

    ``max_test > 0`` caps the test rows over all users, first rows in ``order`` first.  Only the first
    ``stop`` rows per user are ranked (Spark drops later rows before the shuffle), and base is a multiset
    difference, so a user with a third of all rows is never sorted in one task.
    """
    window = W.partitionBy(USER_ID).orderBy(*order)
    test = (
        interactions.withColumn("_n", F.row_number().over(window))
        .filter(F.col("_n") <= stop)
        .filter(F.col("_n") >= start)
        .drop("_n")
    )
    if max_test > 0:
        numbered = number_rows(test, [F.col(c) for c in order], out="_n")
        test = numbered.filter(F.col("_n") < max_test).drop("_n")
    return interactions.exceptAll(test), test


def block_folds(
    interactions: DataFrame, block_rows: int, order: Sequence[str] = ORDER
) -> DataFrame:
    """Add ``fold`` = 1, 2, ...: contiguous blocks of ``block_rows`` rows in ``order``."""
    numbered = number_rows(interactions, [F.col(c) for c in order], out="_row")
    return numbered.withColumn(
        "fold", (F.floor(F.col("_row") / block_rows) + 1).cast("int")
    ).drop("_row")


def hash_folds(interactions: DataFrame, folds: int, keys: Sequence[str] = (USER_ID, ITEM_ID)) -> DataFrame:
    """Add ``fold`` = 1..folds by the first 32 bits of the MD5 of the keys, joined by a bar; no shuffle."""
    head = F.conv(F.substring(F.md5(F.concat_ws("|", *keys).cast("binary")), 1, 8), 16, 10).cast("long")
    return interactions.withColumn("fold", (head % folds + 1).cast("int"))


def fold_split(folded: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """``(base, test)`` of one fold."""
    return (
        folded.filter(F.col("fold") != fold).drop("fold"),
        folded.filter(F.col("fold") == fold).drop("fold"),
    )


def by_user_item(df: DataFrame) -> DataFrame:
    """Order of the shipped splits: user, then item, both as numbers."""
    keys: list[Column] = [F.col(USER_ID).try_cast("long"), F.col(ITEM_ID).try_cast("long")]
    return df.orderBy(*keys)
