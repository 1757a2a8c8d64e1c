"""Column names, table schemas and feature descriptions shared by every module."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Names of columns and kinds.
USER_ID = "user_id"
ITEM_ID = "item_id"
VALUE = "value"
TS = "ts"

USER_IDX = "user_id_int"
ITEM_IDX = "item_id_int"

RAW_SCORE = "raw_score"
SCORE = "score"
FINAL_SCORE = "final_score"
BREAKDOWN = "breakdown"

INTERACTIONS = T.StructType(
    [
        T.StructField(USER_ID, T.StringType(), False),
        T.StructField(ITEM_ID, T.StringType(), False),
        T.StructField(VALUE, T.DoubleType(), True),
        T.StructField(TS, T.TimestampType(), False),
    ]
)

POPULARITY = T.StructType(
    [T.StructField(ITEM_ID, T.StringType()), T.StructField("count", T.LongType())]
)

RECENCY = T.StructType(
    [T.StructField(ITEM_ID, T.StringType()), T.StructField("recency_score", T.DoubleType())]
)

# An interaction on the wire: same four fields, the time as an ISO-8601 string.
EVENT = T.StructType(
    [
        T.StructField(USER_ID, T.StringType()),
        T.StructField(ITEM_ID, T.StringType()),
        T.StructField(VALUE, T.DoubleType()),
        T.StructField(TS, T.StringType()),
    ]
)


class InteractionType(str, Enum):
    EXPLICIT = "explicit"
    IMPLICIT = "implicit"


class FeatureKind(str, Enum):
    CATEGORICAL = "categorical"
    NUMERIC = "numeric"
    ORDINAL = "ordinal"
    TEXT = "text"


class Applies(str, Enum):
    USER = "user"
    ITEM = "item"


@dataclass(frozen=True)
class FeatureSpec:
    """How one feature column is to be encoded, and whether it describes users or items."""

    name: str
    kind: FeatureKind
    applies: Applies


@dataclass(frozen=True)
class Dataset:
    """A source: three DataFrames in the canonical layout plus their feature specs.

    ``users`` and ``items`` may hold only the id column.  ``items`` is the candidate universe: an item
    that occurs in ``interactions`` but not in ``items`` is never recommended.
    """

    name: str
    interactions: DataFrame
    users: DataFrame
    items: DataFrame
    specs: Sequence[FeatureSpec] = field(default_factory=tuple)
    interaction_type: InteractionType = InteractionType.EXPLICIT

    def specs_for(self, applies: Applies) -> list[FeatureSpec]:
        return [s for s in self.specs if s.applies is applies]
