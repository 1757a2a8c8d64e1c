"""Arithmetic on ``array<double>`` vectors whose length is known when the plan is built.

The length is the number of feature columns, so each component is an ordinary column expression and the
work stays inside generated code instead of going through array lambdas.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_array(parts: list[Column]) -> Column:
    return F.array(*parts).cast("array<double>")


def parts_of(vector: Column, dim: int) -> list[Column]:
    return [F.get(vector, j) for j in range(dim)]


def dot(a: Column, b: Column, dim: int) -> Column:
    """Dot product; 0.0 when either vector is null."""
    terms = [x * y for x, y in zip(parts_of(a, dim), parts_of(b, dim))]
    return F.coalesce(reduce(lambda s, t: s + t, terms, F.lit(0.0)), F.lit(0.0))


def norm(parts: list[Column]) -> Column:
    return F.sqrt(reduce(lambda s, t: s + t, [p * p for p in parts], F.lit(0.0)))


def unit(parts: list[Column]) -> Column:
    """L2-normalised vector; a zero vector stays zero."""
    length = norm(parts)
    return as_array([F.when(length > 0, p / length).otherwise(p) for p in parts])
