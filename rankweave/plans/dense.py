"""Signals whose score is a dot product for every user and item (content profiles, latent factors).

Scaling such a signal needs its minimum and maximum over all candidates, so every product has to be
computed; it does not have to be written.  Items are cut into blocks of neighbouring vectors and written once, with
their vectors and common contributions, to the shared folder.  Users are cut into blocks too, one task each, which
holds its users and what they bring along (seen items, rule scores) and reads one item block after the other:
first for the users' extremes, then for their best items.  So items are not shuffled per user block, users
not per item block, and what leaves a task is the top k of its users.

Every task is bounded: an item block has about ``ITEM_BLOCK`` items, a user block at most ``MAX_USER_BLOCK`` users, and a
user has at most one seen entry per item.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.functions.scaling import fixed
from rankweave.operators.numbering import drop, durable, scratch
from rankweave.plans.blocks import BlockScorer
from rankweave.plans.scores import (
    GROUP,
    GROUP_GRAIN,
    ITEM_GRAIN,
    USER_GRAIN,
    DenseScores,
    Scores,
)
from rankweave.schema import ITEM_ID, SCORE, USER_ID

ITEM_BLOCK = 131072
# Items are neighbours by as many bits of as many components.
AXES, BITS = 4, 10
MIN_USER_BLOCK = 512
MAX_USER_BLOCK = 65536


def _places(items: DataFrame, vectors: Mapping[str, tuple[int, float]]) -> Column:
    """A number that is alike for items with like vectors: the bits of ``AXES`` components that differ most, in turn.

    ``vectors`` has the length of each column of vectors and its weight.
    """
    parts = [(F.get(name, j), weight) for name, (dim, weight) in vectors.items() for j in range(dim)]
    plain = [F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x) for x, _ in parts]
    row = items.agg(*[f(x).alias(f"{f.__name__}{j}") for j, x in enumerate(plain) for f in (F.min, F.max, F.stddev_pop)]).first()
    spread = [(row[f"stddev_pop{j}"] or 0.0) * weight for j, (_, weight) in enumerate(parts)]
    chosen = sorted((j for j, x in enumerate(spread) if x > 0), key=lambda j: -spread[j])[:AXES]
    place = F.lit(0).cast("long")
    for n, j in enumerate(chosen):
        lo, hi = row[f"min{j}"], row[f"max{j}"]
        cell = F.coalesce(F.floor((plain[j] - F.lit(lo)) / F.lit(hi - lo) * F.lit((1 << BITS) - 1)), F.lit(0)).cast("long")
        for bit in range(BITS):
            one = F.shiftright(cell, bit).bitwiseAND(F.lit(1).cast("long"))
            place = place.bitwiseOR(F.shiftleft(one, bit * len(chosen) + n))
    return place


def _written(items: DataFrame, blocks: int, vectors: Mapping[str, tuple[int, float]]) -> str:
    """The folder of the item table, a subfolder per block."""
    folder = scratch(items.sparkSession, "item-blocks")
    if blocks > 1:
        # Read for the spread of the components, for the borders of the blocks and for the blocks.
        items = durable(items, "items")
        # Many items of one vector are cut by their ids.
        cut = items.repartitionByRange(blocks, _places(items, vectors), F.xxhash64(ITEM_ID), ITEM_ID)
    else:
        cut = items.repartition(1)
    cut.withColumn("ib", F.spark_partition_id()).write.partitionBy("ib").parquet(folder)
    drop(items)
    return folder


def _block_count(candidates: DataFrame) -> int:
    return max(1, -(-candidates.count() // ITEM_BLOCK))


def user_block_count(users: DataFrame) -> int:
    """Enough user blocks to keep the cluster busy, but none so small that items travel in vain."""
    spark = users.sparkSession
    n = users.count()
    tasks = 4 * spark.sparkContext.defaultParallelism
    size = min(MAX_USER_BLOCK, max(MIN_USER_BLOCK, -(-n // tasks)))
    return max(1, -(-n // size))


def _vectors(dense: Sequence[DenseScores], weights: Mapping[str, float]) -> dict[str, tuple[int, float]]:
    return {f"v_{s.signal}": (s.dim, float(weights.get(s.signal, 1.0))) for s in dense}


def _user_block(user_blocks: int):
    return F.pmod(F.xxhash64(USER_ID), F.lit(user_blocks)).cast("int").alias("ub")


def dense_ranges(users: DataFrame, candidates: DataFrame, dense: Sequence[DenseScores]) -> DataFrame:
    """``(user_id, signal, lo, hi, n, mean, sd)`` over all candidates, for users that are not cold."""
    asked = users.select(USER_ID).distinct()
    who, items = asked, candidates.select(ITEM_ID, F.lit(True).alias("ok"))
    for s in dense:
        who = who.join(s.users.select(USER_ID, F.col("features").alias(f"p_{s.signal}")), USER_ID, "left")
        items = items.join(s.items.select(ITEM_ID, F.col("features").alias(f"v_{s.signal}")), ITEM_ID, "left")
    blocks, user_blocks = _block_count(candidates), user_block_count(asked)
    scorer = BlockScorer([(s.signal, s.dim, s.missing, s.method, 1.0) for s in dense], [], [], [], _written(items, blocks, _vectors(dense, {})), blocks, 0)
    schema = f"{USER_ID} string, signal string, lo double, hi double, n bigint, mean double, sd double"
    dealt = who.select("*", _user_block(user_blocks)).repartition(_tasks(user_blocks), "ub")
    return dealt.groupBy("ub").applyInArrow(lambda part: scorer.ranges(part), schema)


def _tasks(user_blocks: int) -> int:
    """The work per byte is high: blocks must not meet in one task, so most of the partitions stay empty."""
    return 16 * user_blocks


def dense_candidates(
    users: DataFrame,
    candidates: DataFrame,
    pool: DataFrame,
    scores: Sequence[Scores | DenseScores],
    weights: Mapping[str, float],
    seen: DataFrame | None,
    k: int,
) -> DataFrame:
    """``(user_id, item_id, c_<signal>...)``: the k best allowed items of every user, and no more than k of a block
    beyond them where scores are equal.

    Scaling is over ``candidates``; only items in ``pool`` are returned.
    """
    dense = [s for s in scores if isinstance(s, DenseScores)]
    sparse = [s for s in scores if isinstance(s, Scores)]
    item_s = [s for s in sparse if s.grain == ITEM_GRAIN]
    group_s = [s for s in sparse if s.grain == GROUP_GRAIN]
    user_s = [s for s in sparse if s.grain == USER_GRAIN]

    def weighted(s: Scores):
        return fixed(F.col(SCORE) * F.lit(float(weights[s.signal])))

    blocks = _block_count(candidates)
    asked = users.select(USER_ID).distinct()
    user_blocks = user_block_count(asked)

    items = candidates.select(ITEM_ID).join(pool.select(ITEM_ID, F.lit(True).alias("ok")), ITEM_ID, "left").fillna(False, ["ok"])
    for s in item_s:
        part = s.listed.select(ITEM_ID, weighted(s).alias(f"c_{s.signal}"))
        items = items.join(part, ITEM_ID, "left").fillna(0.0, [f"c_{s.signal}"])
    for s in group_s:
        # At most one entry per group.
        part = s.listed.groupBy(ITEM_ID).agg(
            F.collect_list(F.struct(GROUP, weighted(s).alias("c"))).alias("_l")
        )
        items = items.join(
            part.select(
                ITEM_ID,
                F.col(f"_l.{GROUP}").alias(f"lg_{s.signal}"),
                F.col("_l.c").alias(f"lc_{s.signal}"),
            ),
            ITEM_ID,
            "left",
        )
    for s in dense:
        part = s.items.select(ITEM_ID, F.col("features").alias(f"v_{s.signal}"))
        items = items.join(part, ITEM_ID, "left")

    who = asked
    for s in group_s:
        floor = s.floor.select(
            GROUP, F.coalesce(fixed(F.col("floor") * F.lit(float(weights[s.signal]))), F.lit(0.0)).alias(f"f_{s.signal}")
        )
        part = s.members.join(floor, GROUP).select(
            USER_ID, F.col(GROUP).alias(f"g_{s.signal}"), f"f_{s.signal}"
        )
        who = who.join(part, USER_ID, "left")
    for s in user_s:
        part = s.floor.select(
            USER_ID, F.coalesce(fixed(F.col("floor") * F.lit(float(weights[s.signal]))), F.lit(0.0)).alias(f"f_{s.signal}")
        )
        who = who.join(part, USER_ID, "left")
    for s in dense:
        part = s.users.select(USER_ID, F.col("features").alias(f"p_{s.signal}"))
        who = who.join(part, USER_ID, "left")

    def brought(pairs: DataFrame, which: int, value: Column) -> DataFrame:
        """What users bring along: pairs with the signal's place, -1 for seen items."""
        mine = pairs.join(asked, USER_ID, "left_semi")
        return mine.select(USER_ID, ITEM_ID, F.lit(which).alias("which"), value.alias("c"))

    extras = [brought(s.listed, j, weighted(s)) for j, s in enumerate(user_s)]
    if seen is not None:
        extras.append(brought(seen, -1, F.lit(0.0)))
    if not extras:
        kind = f"{USER_ID} string, {ITEM_ID} string, which int, c double"
        extras.append(users.sparkSession.createDataFrame([], kind))

    names = [*[s.signal for s in item_s], *[s.signal for s in dense], *[s.signal for s in group_s], *[s.signal for s in user_s]]
    scorer = BlockScorer(
        [(s.signal, s.dim, s.missing, s.method, float(weights[s.signal])) for s in dense],
        [s.signal for s in item_s],
        [s.signal for s in group_s],
        [s.signal for s in user_s],
        _written(items, blocks, _vectors(dense, weights)),
        blocks,
        k,
    )
    schema = f"{USER_ID} string, {ITEM_ID} string, " + ", ".join(f"c_{n} double" for n in names)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return scorer.top(left, right)

    tasks = _tasks(user_blocks)
    deal = lambda df: df.select("*", _user_block(user_blocks)).repartition(tasks, "ub").groupBy("ub")
    return deal(who).cogroup(deal(reduce(DataFrame.unionByName, extras))).applyInArrow(run, schema)
