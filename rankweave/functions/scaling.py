"""Score scaling and fixed-point contributions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINMAX = "minmax"
ZSCORE = "zscore"

# Contributions lie on a grid fine enough for every double between -1 and 1 that differs by more than the
# rounding noise of a few additions.  A tie goes to the smaller item id.
DIGITS = 14
# A row whose spread is within the rounding noise of its values is flat.
NOISE = 1e-15


def minmax(x: Column, lo: Column, hi: Column) -> Column:
    """``(x - lo) / (hi - lo)``; 0.5 when all scores are equal or all are null."""
    flat = lo.isNull() | (lo == hi)
    return F.when(flat, F.lit(0.5)).otherwise((x - lo) / (hi - lo))


def zscore(x: Column, mean: Column, sd: Column, lo: Column, hi: Column) -> Column:
    """``(x - mean) / sd``; 0 when all scores are equal."""
    flat = sd.isNull() | (sd == 0) | (hi - lo <= F.lit(NOISE) * F.greatest(F.abs(lo), F.abs(hi)))
    return F.when(flat, F.lit(0.0)).otherwise((x - mean) / sd)


def scaled(x: Column, stats: dict[str, Column], method: str = MINMAX) -> Column:
    if method == MINMAX:
        return minmax(x, stats["lo"], stats["hi"])
    if method == ZSCORE:
        return zscore(x, stats["mean"], stats["sd"], stats["lo"], stats["hi"])
    raise ValueError(f"unknown normalization {method!r}")


def fixed(x: Column) -> Column:
    """Round to ``DIGITS`` decimals.

    Contributions are rounded before they are added, so a sum does not depend on the order of addition
    and adding the same constant to two items never changes which of them comes first.
    """
    return F.round(x, DIGITS)


def total(parts: list[Column]) -> Column:
    """Sum of fixed contributions, null parts counting 0, itself back on the fixed grid."""
    out = F.lit(0.0)
    for part in parts:
        out = out + F.coalesce(part, F.lit(0.0))
    return fixed(out)
