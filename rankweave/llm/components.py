"""Connected components of an edge table by alternating stars, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.operators.numbering import drop, durable


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the edges ``(a, b)``, written out: the smallest node it is connected with.

    Every round is written to the shared folder; the rounds end when the edges stay the same, after about
    the logarithm of the longest path.
    """
    now, mark = durable(edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct(), "edges"), None
    while True:
        before, now = now, durable(_small_star(_large_star(now)), "edges")
        drop(before)
        sums = [F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
        found = tuple(now.agg(*sums).first())
        if found == mark:
            break
        mark = found
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = durable(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "roots")
    drop(now)
    return roots
