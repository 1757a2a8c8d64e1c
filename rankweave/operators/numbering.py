"""Consecutive row numbers over a total order without gathering the rows in one task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# monotonically_increasing_id() keeps the position inside a partition in its low 33 bits.
_IN_PARTITION = (1 << 33) - 1


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's checkpoint folder; make one up only in local mode (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="rankweave-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


# Ids and numbers take several times the size of their Parquet files once they are rows.
UNPACKED = 8.0
_FACTOR = "spark.sql.sources.fileCompressionFactor"


def unpacked_sizes(spark: SparkSession) -> None:
    """Let Spark's size check count rows instead of files, unless the session has a factor of its own.

    Otherwise a table of a million ids passes for a few MB and goes through the driver as a broadcast.
    """
    if float(spark.conf.get(_FACTOR)) == 1.0:
        spark.conf.set(_FACTOR, str(UNPACKED))


# The folder of the run that is going on, if any.
_RUN: ContextVar[str | None] = ContextVar("run", default=None)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the folder of the run, or below the session's checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{_RUN.get() or spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scoped(spark: SparkSession, name: str = "run") -> Iterator[str]:
    """A run that owns every folder made inside; all of them go when it ends, whether it succeeds or fails.

    Write the results elsewhere before it ends: frames that read the run's tables are worth nothing afterwards.
    """
    folder = scratch(spark, name)
    before = _RUN.set(folder)
    try:
        yield folder
    finally:
        _RUN.reset(before)
        remove(spark, folder)


def durable(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    Cuts lineage, survives the loss of executors, and what reads it later sees its size and can prune
    columns.  A run that knows the last reader of a table gives it to ``drop``; what a result still reads stays
    until the cluster cleans its checkpoint folder.
    """
    unpacked_sizes(df.sparkSession)
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark can write."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``durable`` wrote and no unfinished frame reads any more; other frames are left alone."""
    for table in tables:
        path = vars(table).get("scratch_path")
        if path is not None:
            remove(table.sparkSession, path)


def number_rows(
    df: DataFrame,
    order: Sequence[Column],
    within: Sequence[str] = (),
    out: str = "pos",
) -> DataFrame:
    """Add ``out`` = 0, 1, 2, ... by ``order``, restarting for every value of ``within``.

    ``order`` has to be total up to rows that are equal in all columns.  The rows are range-partitioned
    on ``within + order`` and numbered inside each partition; a group of any size therefore spreads over
    as many partitions as it needs.  The sampled partition bounds must not move between the count and the
    numbering, so the ranged rows are written out first.  Only per-partition counts (one row per shuffle
    partition) and per-group starts are joined back.
    """
    spark = df.sparkSession
    keys = [F.col(c) for c in within] + list(order)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(
        df.repartitionByRange(partitions, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION)))
    )
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    numbered = (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_offset") + F.col("_seq"))
        .drop("_part", "_seq", "_offset")
    )
    if not within:
        return numbered
    group = [F.col(c).alias(f"_g{j}") for j, c in enumerate(within)]
    starts = numbered.groupBy(*group).agg(F.min(out).alias("_start"))
    # Null-safe: a null group is a group too.
    same = [F.col(c).eqNullSafe(F.col(f"_g{j}")) for j, c in enumerate(within)]
    return numbered.join(starts, same).select(
        *df.columns, (F.col(out) - F.col("_start")).alias(out)
    )
