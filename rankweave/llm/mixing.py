"""Mix sources to target weights by capped water-filling.

Every source asks for a share of the words in proportion to its weight.  A source that would have to be repeated
more than ``epochs`` times is clamped there, and what it cannot give is shared among the others by weight, until
none is above.  A source then takes every document a whole number of times and, for the fraction left over, the
documents that come first in a seeded order; the one at the border gives only as many of its first words as are
missing, so that a source is less than one word off its target.

Plan.  Sizes and seeded numbers are written once, a few bytes a document.  The targets are a table with a row per
source; each round of clamping is one sum over it.  The border of a source is found by cutting its numbers into
``2 ** BITS`` ranges and going on inside the range that holds the border, so that no window or task sees more than
these ranges of one source, whatever share of the documents it has.  All work is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankweave.operators.numbering import durable, number_rows

WORD = r"[^\x20\x09-\x0D]+"
EPOCHS = 3
SEED = 0
# A document's number has 60 bits and is looked at in steps of so many.
NUMBER, BITS = 60, 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def cyclic_weights(sources: DataFrame) -> DataFrame:
    """``(source, weight)``: 1, 2, 3, 1, 2, 3, ... in the order of the code points, the null source last."""
    order = [F.col("source").isNull(), F.col("source")]
    return number_rows(sources.select("source").distinct(), order).select("source", (F.col("pos") % 3 + 1).alias("weight"))


def water_fill(sources: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """Add ``target`` to ``(source, source_size, weight)``; targets sum to the sum of the sizes.

    With a level L a source gets L words per unit of weight, at most ``epochs`` times its size.  A round raises
    the level by sharing what the clamped sources leave among the others; clamped sources stay so.  The level is
    all that goes from round to round.  A weight of null, 0 or less takes nothing.
    """
    weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(0)
    cap = F.col("source_size") * epochs
    whole, level = sources.agg(F.sum("source_size")).first()[0] or 0, 0.0
    while True:
        clamped = cap <= F.lit(level) * weight
        given, free = sources.agg(F.sum(F.when(clamped, cap)), F.sum(F.when(~clamped, weight))).first()
        raised = (whole - (given or 0)) / free if free else level
        if raised <= level:
            break
        level = raised
    share = F.lit(level) * weight
    return sources.withColumn("target", F.when(cap <= share, cap.cast("double")).otherwise(share.cast("double")))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _borders(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, border, bits, missing)``: documents whose number starts below ``border`` (its first ``bits`` bits) are
    taken once more; those that start with it give the ``missing`` words."""
    here = sized.select(F.col("source").alias("s"), "number", "size")
    now = targets.filter(F.col("rest") > 0).select("source", F.lit(0).cast("bigint").alias("border"), F.col("rest").alias("missing"))
    bits = 0
    while True:
        bits += BITS
        inside = here.join(now, _same("s", "source")).filter(F.shiftright("number", NUMBER - bits + BITS) == F.col("border"))
        ranges = inside.groupBy("source", "missing", F.shiftright("number", NUMBER - bits).alias("border")).agg(
            F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")
        )
        order = W.partitionBy("source").orderBy("border").rowsBetween(W.unboundedPreceding, -1)
        before = F.coalesce(F.sum("words").over(order), F.lit(0))
        holds = (F.col("before") < F.col("missing")) & (F.col("missing") <= F.col("before") + F.col("words"))
        found = ranges.withColumn("before", before).filter(holds)
        found = durable(found.select("source", "border", (F.col("missing") - F.col("before")).alias("missing"), "rows"), "borders")
        most = found.agg(F.max("rows")).first()[0] or 0
        if most <= 1 or bits == NUMBER:
            return found.withColumn("bits", F.lit(bits))
        now = found.select("source", "border", "missing")


def mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    epochs: int = EPOCHS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: its id, ``size`` in words, ``source_size``, ``target`` of its source in words, and
    ``taken``, the words the mix takes of it with repeats, at most ``epochs`` times its size.

    ``weights`` has ``(source, weight)``, a row per source, null for the null source; without it weights are 1, 2, 3,
    repeating.  The same documents, weights and seed give the same rows, however the table is partitioned.

    Null and empty texts: size 0, nothing taken.  A null id takes part.  Rows with equal id and text have one
    number; where the border falls among them any of them may be taken, which cannot be told apart.  A source
    without words has target 0.  Texts of any length count in full.  Empty table: no rows.  Other columns are ignored.
    """
    text = F.col(text_col).cast("string")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    number = F.conv(F.substring(F.md5(name.cast("binary")), 1, NUMBER // 4), 16, 10).cast("bigint")
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), number.alias("number"))
    sized = durable(sized, "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    given = (cyclic_weights(sources) if weights is None else weights).select(F.col("source").alias("s"), "weight")
    sources = durable(sources.join(given, _same("source", "s"), "left").drop("s"), "sources")
    targets = water_fill(sources, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    targets = targets.withColumn("whole", whole).withColumn("rest", F.floor("target") - F.col("whole") * F.col("source_size"))
    targets = durable(targets, "targets")
    borders = _borders(sized, targets)
    known = targets.join(borders.withColumnRenamed("source", "s"), _same("source", "s"), "left").drop("s")
    known = known.select(F.col("source").alias("s"), "source_size", "target", "whole", "border", "bits", "missing", "rows")
    rows = sized.join(known, _same("source", "s")).drop("s")
    start = F.expr(f"shiftright(number, {NUMBER} - bits)")
    # Rows that share the border's number are told apart by their place; there are several only among equal rows.
    tied = (start == F.col("border")) & (F.col("rows") > 1)
    rows = rows.withColumn("place", F.lit(0).cast("bigint"))
    if not borders.filter(F.col("rows") > 1).isEmpty():
        among = rows.filter(tied)
        among = number_rows(among.drop("place"), [F.col("size").desc(), F.col("id")], ["source"], out="place")
        rows = rows.filter(F.coalesce(~tied, F.lit(True))).unionByName(among)
    part = F.least("size", F.greatest(F.lit(0), F.col("missing") - F.col("place") * F.col("size")))
    extra = F.when(start < F.col("border"), F.col("size")).when(start == F.col("border"), part).otherwise(0)
    taken = F.col("whole") * F.col("size") + F.coalesce(extra, F.lit(0))
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("bigint").alias("taken"), "number")


def repeated(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mixed corpus itself: a row of ``docs`` for every repetition, with ``copy`` counting from 0.

    The last repetition of a document at the border has only its first words, joined by a space; all others have
    the text as it is.  ``mixed`` is the result of ``mix``; ids have to be unique.  Documents of which nothing is taken
    are left out.
    """
    plan = mixed.filter(F.col("taken") > 0).select(F.col(id_col).alias("_id"), F.col("size").alias("_size"), F.col("taken").alias("_taken"))
    rows = docs.join(plan, _same(id_col, "_id"))
    copies = F.sequence(F.lit(0), (F.ceil(F.col("_taken") / F.col("_size")) - 1).cast("int"))
    rows = rows.withColumn("copy", F.explode(copies))
    left = F.col("_taken") - F.col("copy") * F.col("_size")
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)), F.lit(1), left.cast("int")), " ")
    return rows.withColumn(text_col, F.when(left < F.col("_size"), cut).otherwise(F.col(text_col))).drop("_id", "_size", "_taken")


def digest(docs: DataFrame) -> DataFrame:
    """The rows of the registered query."""
    return mix(docs).drop("number")


# Clamping as a recursion over the level; the border by a running sum in the order of the numbers.
ORACLE = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) size,
         substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, {NUMBER // 4}) number
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) source_size,
             (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 weight FROM d GROUP BY source),
fill AS (
  SELECT 0 round, CAST(0 AS DOUBLE) level
  UNION ALL
  SELECT round + 1, raised FROM (
    SELECT round, level, ((SELECT CAST(sum(source_size) AS DOUBLE) FROM s)
             - (SELECT CAST(coalesce(sum(source_size * {EPOCHS}), 0) AS DOUBLE) FROM s WHERE source_size * {EPOCHS} <= level * weight))
           / (SELECT CAST(sum(weight) AS DOUBLE) FROM s WHERE source_size * {EPOCHS} > level * weight) raised
    FROM fill) WHERE raised > level),
t AS (SELECT source, source_size,
             CASE WHEN source_size * {EPOCHS} <= level * weight THEN CAST(source_size * {EPOCHS} AS DOUBLE) ELSE level * weight END target
      FROM s, (SELECT max(level) level FROM fill)),
u AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END whole FROM t),
o AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY number, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) before
      FROM d)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, floor(target) - whole * source_size - before)) AS BIGINT) taken
FROM o JOIN u ON o.source IS NOT DISTINCT FROM u.source"""
