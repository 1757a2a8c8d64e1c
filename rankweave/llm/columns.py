"""Column expressions shared by the operators that run without Python on the executors."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def spans(text: Column, pattern: str, kind: str, keep: Callable[[Column, Column], Column], group: int = 0) -> Column:
    """``array<struct<start, end, kind>>`` of the leftmost matches, in code points, end exclusive.

    The gaps between matches come from a split at the same pattern, so positions are running lengths.
    ``keep`` sees the match and its ``group`` and may refuse it; the text it covers stays used.
    """
    found = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g"),
        F.split(text, pattern, -1).alias("gap"),
    )
    # The last gap has no match behind it.
    found = F.filter(found, lambda x: x["m"].isNotNull())
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"))
        return F.struct(
            end.alias("at"),
            F.when(keep(x["m"], x["g"]), F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    return F.aggregate(found, start, step, lambda state: state["out"])


def through_arrow(df: DataFrame, run: Callable) -> DataFrame:
    """``df.mapInArrow(run)`` with the same columns, whatever their names; ``run`` sees them in order."""
    bounded_batches(df.sparkSession)
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


# Bytes that a Python worker gets at once.
BATCH = 8 << 20


def bounded_batches(spark: SparkSession, size: int = BATCH) -> None:
    """From now on the session hands its Python workers at most about ``size`` bytes at once.

    Long texts make large batches, and executors keep the buffers of the largest one.  The setting is the session's,
    because a frame is planned when it is used, not when it is made; a smaller one stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < now <= size:
        spark.conf.set(name, size)


def no_spans() -> Column:
    return F.array().cast("array<struct<start:int,end:int,kind:string>>")


def range_bucket(value: Column, bounds: Sequence[int]) -> Column:
    """How many of the ascending ``bounds`` are at most ``value``, less one, found in two levels."""
    width = max(1, int(len(bounds) ** 0.5))
    rows = [list(bounds[i : i + width]) for i in range(0, len(bounds), width)]
    heads = F.array(*[F.lit(r[0]) for r in rows])
    grid = F.array(*[F.array(*[F.lit(b) for b in r]) for r in rows])
    below = lambda bound: bound <= value
    return let(
        F.size(F.filter(heads, below)) - 1,
        lambda row: row * width + F.size(F.filter(F.get(grid, row), below)) - 1,
    )
