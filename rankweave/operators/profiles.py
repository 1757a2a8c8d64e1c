"""User taste profiles: weighted centroids of item vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.functions.scalars import interaction_weight
from rankweave.functions.vectors import parts_of, unit
from rankweave.operators.encode import Vectors
from rankweave.schema import ITEM_ID, USER_ID, VALUE


def user_profiles(interactions: DataFrame, item_vectors: Vectors) -> Vectors:
    """``(user_id, features)``: mean of the vectors of a user's items, weighted by value, unit length.

    Duplicates count repeatedly; weights that add up to zero give the plain mean; items without a vector
    do not take part.  One sum per component, so partial sums are built before the shuffle and a user
    with very many interactions costs no more than any other.
    """
    weighted = interactions.select(
        USER_ID, ITEM_ID, interaction_weight(F.col(VALUE)).alias("_w")
    ).join(item_vectors.table.select(ITEM_ID, "features"), ITEM_ID)
    components = parts_of(F.col("features"), item_vectors.dim)
    sums = [F.sum(F.col("_w") * c).alias(f"_s{j}") for j, c in enumerate(components)]
    plain = [F.sum(c).alias(f"_p{j}") for j, c in enumerate(components)]
    totals = weighted.groupBy(USER_ID).agg(
        F.sum("_w").alias("_w"), F.count(F.lit(1)).alias("_n"), *sums, *plain
    )
    mean = [
        F.when(F.col("_w") == 0, F.col(f"_p{j}") / F.col("_n")).otherwise(
            F.col(f"_s{j}") / F.when(F.col("_w") != 0, F.col("_w"))
        )
        for j in range(item_vectors.dim)
    ]
    centroid = totals.select(USER_ID, *[m.alias(f"_m{j}") for j, m in enumerate(mean)])
    profile = unit([F.col(f"_m{j}") for j in range(item_vectors.dim)])
    return Vectors(centroid.select(USER_ID, profile.alias("features")), item_vectors.names)
