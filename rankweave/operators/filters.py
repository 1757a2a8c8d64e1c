"""Candidate generation, seen items and exclusion filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.schema import ITEM_ID, USER_ID, VALUE


@dataclass(frozen=True)
class Filters:
    """``exclude_items`` may be a list of ids or, when long, a DataFrame with ``item_id``."""

    exclude_seen: bool = True
    exclude_items: Sequence[str] | DataFrame = ()
    require_features: Mapping[str, Any] = field(default_factory=dict)


def exclude_items(df: DataFrame, excluded: Sequence[str] | DataFrame) -> DataFrame:
    if isinstance(excluded, DataFrame):
        return df.join(excluded.select(ITEM_ID), ITEM_ID, "left_anti")
    if not excluded:
        return df
    return df.filter(~F.col(ITEM_ID).isin(list(excluded)))


def require_features(df: DataFrame, items: DataFrame, wanted: Mapping[str, Any]) -> DataFrame:
    """Keep items whose features equal the wanted values."""
    if not wanted:
        return df
    fitting = items
    for name, value in wanted.items():
        fitting = fitting.filter(F.col(name) == F.lit(value))
    return df.join(fitting.select(ITEM_ID), ITEM_ID, "left_semi")


def exclude_seen(df: DataFrame, seen: DataFrame) -> DataFrame:
    """Anti join on both ids, so no user's history ends up in one task."""
    return df.join(seen.select(USER_ID, ITEM_ID), [USER_ID, ITEM_ID], "left_anti")


def apply_filters(
    df: DataFrame, filters: Filters, seen: DataFrame | None = None, items: DataFrame | None = None
) -> DataFrame:
    """Seen items, then excluded items, then required features."""
    if filters.exclude_seen and seen is not None:
        df = exclude_seen(df, seen)
    df = exclude_items(df, filters.exclude_items)
    if filters.require_features:
        if items is None:
            raise ValueError("require_features needs the item table")
        df = require_features(df, items, filters.require_features)
    return df


def candidates(items: DataFrame, excluded: Sequence[str] | DataFrame = ()) -> DataFrame:
    """Distinct items of the item table, minus an optional exclude list."""
    return exclude_items(items.select(ITEM_ID).filter(F.col(ITEM_ID).isNotNull()).distinct(), excluded)


def seen_items(interactions: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Distinct ``(user_id, item_id)``, for ``users`` only when given."""
    if users is not None:
        interactions = for_users(interactions, users)
    return interactions.select(USER_ID, ITEM_ID).distinct()


def for_user(df: DataFrame, user_id: str) -> DataFrame:
    return df.filter(F.col(USER_ID) == user_id)


def for_users(df: DataFrame, users: DataFrame) -> DataFrame:
    return df.join(users.select(USER_ID), USER_ID, "left_semi")


def with_value(interactions: DataFrame) -> DataFrame:
    return interactions.filter(F.col(VALUE).isNotNull())
