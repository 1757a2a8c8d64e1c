"""Baskets, association rules and basket-rule matching."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.functions.scalars import contains_all
from rankweave.operators.encode import BROADCAST_BYTES
from rankweave.operators.numbering import durable, number_rows
from rankweave.schema import ITEM_ID, USER_ID

# Three numbers.
COUNTED_BYTES = 24


def frequent_items(owned: DataFrame, min_support: float) -> DataFrame:
    """``(item_id, freq)`` of items held by at least ``min_support`` of the baskets.

    ``owned`` holds distinct ``(user_id, item_id)`` rows.  Their number is at most the mean basket size
    divided by ``min_support``, whatever the catalogue size.
    """
    floor = owned.agg(F.ceil(F.count_distinct(USER_ID) * F.lit(float(min_support)))).scalar()
    freq = owned.groupBy(ITEM_ID).agg(F.count(F.lit(1)).alias("freq"))
    return freq.filter(F.col("freq") >= floor)


def baskets(owned: DataFrame, min_support: float | None = None) -> DataFrame:
    """``(user_id, items array<string>)``, items sorted.

    With ``min_support`` only frequent items are gathered, which bounds a basket by the number of
    frequent items.  No rule can hold any other item, so rules and their matches stay the same; users
    left without items keep an empty basket, because supports count them.
    """
    if min_support is None:
        return owned.groupBy(USER_ID).agg(F.sort_array(F.collect_set(ITEM_ID)).alias("items"))
    kept = frequent_items(owned, min_support).select(ITEM_ID, F.lit(True).alias("_keep"))
    return (
        owned.join(kept, ITEM_ID, "left")
        .groupBy(USER_ID)
        .agg(F.sort_array(F.collect_set(F.when(F.col("_keep"), F.col(ITEM_ID)))).alias("items"))
    )


def frequent_sets(owned: DataFrame, least: int) -> DataFrame:
    """``(items array<string>, freq)``: all sets of items that at least ``least`` users own, items sorted.

    Sets grow by one item a level.  A row holds a user's sets that differ in the last item only; two of them give a
    candidate, and candidates are counted before the shuffle.  So a task holds counts, never the baskets.
    """
    freq = owned.groupBy(ITEM_ID).agg(F.count(F.lit(1)).alias("freq")).filter(F.col("freq") >= least)
    single = durable(number_rows(freq, [F.asc(ITEM_ID)], out="last"), "items")
    levels = [single.select(F.col("last").alias("id"), F.array(ITEM_ID).alias("items"), "freq")]
    found = owned.join(single, ITEM_ID).select(USER_ID, F.lit(0).cast("long").alias("parent"), "last", F.col("last").alias("id"))
    while True:
        siblings = durable(
            found.groupBy(USER_ID, "parent")
            .agg(F.sort_array(F.collect_list(F.struct("last", "id"))).alias("sets"))
            .filter(F.size("sets") > 1)
            .select(USER_ID, "sets"),
            "siblings",
        )
        pairs = siblings.select(USER_ID, "sets", F.posexplode("sets.id").alias("at", "parent")).select(
            USER_ID, "parent", F.explode(F.expr("slice(sets.last, at + 2, size(sets))")).alias("last")
        )
        counts = pairs.groupBy("parent", "last").agg(F.count(F.lit(1)).alias("freq")).filter(F.col("freq") >= least)
        counts = durable(counts.withColumn("id", F.monotonically_increasing_id()), "counts")
        n = counts.count()
        if not n:
            break
        kept = counts.drop("freq")
        # Of very many pairs few are frequent; while these are small the pairs are not shuffled again.
        found = pairs.join(F.broadcast(kept) if n * COUNTED_BYTES <= BROADCAST_BYTES else kept, ["parent", "last"])
        parents = levels[-1].select(F.col("id").alias("parent"), "items")
        named = counts.join(parents, "parent").join(single.select("last", ITEM_ID), "last")
        whole = F.concat("items", F.array(ITEM_ID)).alias("items")
        levels.append(durable(named.select("id", whole, "freq"), "sets"))
    return reduce(DataFrame.unionByName, levels).select("items", "freq")


def mine_rules(owned: DataFrame, min_support: float = 0.01, min_confidence: float = 0.2) -> DataFrame:
    """Association rules ``(antecedent, consequent, confidence, lift, support)``, consequents of one item.

    ``owned`` holds distinct ``(user_id, item_id)`` rows; it is read several times.
    """
    n = owned.agg(F.count_distinct(USER_ID)).first()[0]
    sets = frequent_sets(owned, math.ceil(n * float(min_support)))
    split = sets.filter(F.size("items") > 1).select("freq", F.explode("items").alias("one"), "items")
    split = split.select("freq", F.array("one").alias("consequent"), F.array_remove("items", F.col("one")).alias("antecedent"))
    before = sets.select(F.col("items").alias("antecedent"), F.col("freq").alias("_before"))
    alone = sets.filter(F.size("items") == 1).select(F.col("items").alias("consequent"), F.col("freq").alias("_alone"))
    rules = split.join(before, "antecedent").join(alone, "consequent")
    confidence = F.col("freq") / F.col("_before")
    return rules.select(
        "antecedent",
        "consequent",
        confidence.alias("confidence"),
        (confidence / (F.col("_alone") / F.lit(float(n)))).alias("lift"),
        (F.col("freq") / F.lit(float(n))).alias("support"),
    ).filter(F.col("confidence") >= min_confidence)


def met_antecedents(rules: DataFrame, owned: DataFrame) -> DataFrame:
    """``(user_id, antecedent)``: which users own every item of which antecedent.

    Each antecedent is looked up once, by its rarest item, so the join yields no more rows than that
    item has owners; the other items are then checked against the basket.  A basket holds only items
    that occur in some antecedent, all of them frequent, which bounds its size.
    """
    wanted = (
        rules.select(F.sort_array(F.array_distinct("antecedent")).alias("antecedent"))
        .distinct()
        .select("antecedent", F.explode("antecedent").alias(ITEM_ID))
    )
    owners = owned.groupBy(ITEM_ID).agg(F.count(F.lit(1)).alias("_freq"))
    anchored = (
        wanted.join(owners, ITEM_ID, "left")
        .groupBy("antecedent")
        .agg(F.min_by(ITEM_ID, F.struct(F.coalesce("_freq", F.lit(0)), ITEM_ID)).alias(ITEM_ID))
    )
    found = owned.join(anchored, ITEM_ID).select(USER_ID, "antecedent")
    relevant = owned.join(wanted.select(ITEM_ID).distinct(), ITEM_ID, "left_semi")
    checked = (
        found.filter(F.size("antecedent") > 1)
        .join(baskets(relevant), USER_ID)
        .filter(contains_all(F.col("items"), F.col("antecedent")))
        .select(USER_ID, "antecedent")
    )
    return found.filter(F.size("antecedent") == 1).unionByName(checked)


def matched_confidence(rules: DataFrame, owned: DataFrame) -> DataFrame:
    """``(user_id, item_id, confidence)``: best confidence per consequent of the rules a user meets.

    ``owned`` holds distinct ``(user_id, item_id)`` rows.
    """
    best = (
        rules.select(
            F.sort_array(F.array_distinct("antecedent")).alias("antecedent"),
            F.explode("consequent").alias(ITEM_ID),
            "confidence",
        )
        .groupBy("antecedent", ITEM_ID)
        .agg(F.max("confidence").alias("confidence"))
    )
    return (
        met_antecedents(rules, owned)
        .join(best, "antecedent")
        .groupBy(USER_ID, ITEM_ID)
        .agg(F.max("confidence").alias("confidence"))
    )
