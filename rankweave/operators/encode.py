"""Label indexing, id mapping and feature vectors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.functions.vectors import as_array, unit
from rankweave.operators.numbering import number_rows
from rankweave.schema import (
    ITEM_ID,
    ITEM_IDX,
    USER_ID,
    USER_IDX,
    FeatureKind,
    FeatureSpec,
)

# A label table is broadcast only while its measured size stays below this.
BROADCAST_BYTES = 32 * 1024 * 1024


@dataclass(frozen=True)
class Labels:
    """``table(column, label, idx)``: per column, labels by falling frequency, ties by label.

    ``counts`` and ``bytes`` hold one number per indexed column.
    """

    table: DataFrame
    counts: Mapping[str, int]
    bytes: Mapping[str, int]

    def encoded(self, df: DataFrame, column: str, out: str) -> DataFrame:
        """Add the index of ``column`` as double; null and unknown labels get the label count."""
        part = self.table.filter(F.col("column") == column).select(
            F.col("label").alias("_label"), F.col("idx").alias("_idx")
        )
        if self.bytes.get(column, 0) <= BROADCAST_BYTES:
            part = F.broadcast(part)
        missing = F.lit(float(self.counts.get(column, 0)))
        joined = df.join(part, F.col(column).cast("string") == F.col("_label"), "left")
        return joined.withColumn(out, F.coalesce(F.col("_idx").cast("double"), missing)).drop(
            "_label", "_idx"
        )


def fit_labels(df: DataFrame, columns: Sequence[str]) -> Labels:
    """Index several string columns in one pass over ``df``."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "label"
    )
    freq = (
        long.filter(F.col("label").isNotNull())
        .groupBy("column", "label")
        .agg(F.count(F.lit(1)).alias("freq"))
    )
    table = number_rows(freq, [F.desc("freq"), F.asc("label")], ["column"], "idx")
    # One row per indexed column.
    sizes = (
        table.groupBy("column")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.octet_length("label") + F.lit(24)).alias("size"),
        )
        .collect()
    )
    return Labels(
        table.select("column", "label", "idx"),
        {r["column"]: r["n"] for r in sizes},
        {r["column"]: r["size"] for r in sizes},
    )


@dataclass(frozen=True)
class IdIndex:
    """String ids to consecutive integers and back, as two tables ``(id, idx)``.

    Most frequent id first, ties by id.  The tables are joined, never collected, so the number of ids
    is not limited by the driver.
    """

    users: DataFrame
    items: DataFrame

    @staticmethod
    def fit(interactions: DataFrame) -> IdIndex:
        def index(column: str, out: str) -> DataFrame:
            freq = (
                interactions.filter(F.col(column).isNotNull())
                .groupBy(column)
                .agg(F.count(F.lit(1)).alias("freq"))
            )
            return number_rows(freq, [F.desc("freq"), F.asc(column)], out=out).select(column, out)

        return IdIndex(index(USER_ID, USER_IDX), index(ITEM_ID, ITEM_IDX))

    def transform(self, df: DataFrame, unknown: str = "keep") -> DataFrame:
        """Add the integer of every id column that ``df`` has.

        ``keep`` gives unknown ids the number of known ids, ``drop`` removes their rows.
        """
        for column, out, table in (
            (USER_ID, USER_IDX, self.users),
            (ITEM_ID, ITEM_IDX, self.items),
        ):
            if column not in df.columns:
                continue
            if unknown == "drop":
                df = df.join(table, column)
            else:
                n = table.agg(F.count(F.lit(1))).scalar()
                df = df.join(table, column, "left").withColumn(out, F.coalesce(F.col(out), n))
        return df

    def inverse(self, df: DataFrame) -> DataFrame:
        """Add the string of every integer column that ``df`` has; unknown integers give null."""
        for column, out, table in (
            (USER_ID, USER_IDX, self.users),
            (ITEM_ID, ITEM_IDX, self.items),
        ):
            if out in df.columns:
                df = df.join(table, out, "left")
        return df

    def user_idx(self, user_id: str) -> DataFrame:
        return self.users.filter(F.col(USER_ID) == user_id).select(USER_IDX)

    def item_idx(self, item_id: str) -> DataFrame:
        return self.items.filter(F.col(ITEM_ID) == item_id).select(ITEM_IDX)

    def user_of(self, idx: int) -> DataFrame:
        return self.users.filter(F.col(USER_IDX) == idx).select(USER_ID)

    def item_of(self, idx: int) -> DataFrame:
        return self.items.filter(F.col(ITEM_IDX) == idx).select(ITEM_ID)


@dataclass(frozen=True)
class Vectors:
    """``table(id, features array<double>)`` with ``dim`` components named by ``names``."""

    table: DataFrame
    names: tuple[str, ...]

    @property
    def dim(self) -> int:
        return len(self.names)


def _encoding(df: DataFrame, id_column: str, specs: Sequence[FeatureSpec] | None, text: bool):
    """``(categorical, numeric)`` column names, in table or spec order, as one ordered list of pairs."""
    if specs is None:
        return [
            (f.name, isinstance(f.dataType, (T.StringType, T.VarcharType, T.CharType)))
            for f in df.schema.fields
            if f.name != id_column
        ]
    chosen = []
    for spec in specs:
        if spec.kind is FeatureKind.TEXT and not text:
            continue
        chosen.append((spec.name, spec.kind in (FeatureKind.CATEGORICAL, FeatureKind.TEXT)))
    return chosen


def vectorize(
    df: DataFrame,
    id_column: str,
    specs: Sequence[FeatureSpec] | None = None,
    *,
    include_text: bool = False,
    weights: Mapping[str, float] | None = None,
    normalize: bool = False,
) -> Vectors:
    """Encode feature columns into one vector per row.

    Without ``specs`` every column but the id takes part and string columns are indexed; with ``specs``
    the declared kinds decide and free text stays out unless ``include_text``.  Rows with a null or NaN
    number are left out, a null label gets its own index.  ``weights`` scales components (default 1).
    """
    chosen = _encoding(df, id_column, specs, include_text)
    labelled = [name for name, is_label in chosen if is_label]
    out = df.select(id_column, *[name for name, _ in chosen])
    labels = fit_labels(out, labelled) if labelled else None
    parts: list[Column] = []
    keep = F.lit(True)
    for name, is_label in chosen:
        if is_label:
            encoded = f"_idx_{name}"
            out = labels.encoded(out, name, encoded)
            part = F.col(encoded)
        else:
            part = F.col(name).cast("double")
            keep = keep & part.isNotNull() & ~F.isnan(part)
        weight = (weights or {}).get(name, 1.0)
        parts.append(part if weight == 1.0 else part * F.lit(float(weight)))
    vector = unit(parts) if normalize else as_array(parts)
    return Vectors(
        out.filter(keep).select(id_column, vector.alias("features")), tuple(n for n, _ in chosen)
    )
