"""Document fingerprints from closed syncmers of words.

A k-mer is five words.  It is chosen when the smallest of its four two-word hashes is its first or its last,
which depends on the k-mer alone: an edit changes the choice of the five k-mers it touches and of no other.
The chosen k-mers with their positions are the anchors; the 64 smallest of their hashes are the printed
fingerprint.  The likeness of two texts is taken from all their anchors, matched by hash and position: one text
is moved along the other by the offset on which most common hashes agree, and the likeness is the share of
anchors that then coincide among all different ones.  So parts in another order do not count, and words put in
or left out split a match in two, of which the larger counts.

All work is column expressions over one row; a row is bounded by its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankweave.llm.columns import let, range_bucket

WORDS = 5
KEPT = 64
_LEAST = -(1 << 63)
# A coded anchor is its hash followed by 31 bits of position.
_PLACE = (1 << 31) - 1


def _word_hashes(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def _chosen(h: Column) -> Column:
    """First words of the closed syncmers; of all k-mers if there is none."""
    n = F.size(h)
    pairs = F.zip_with(F.slice(h, 1, n - 1), F.slice(h, 2, n - 1), lambda a, b: F.xxhash64(a, b))
    every = F.sequence(F.lit(0), n - WORDS)

    def choose(s: Column) -> Column:
        closed = F.filter(
            every,
            lambda i: F.least(F.get(s, i), F.get(s, i + 3)) <= F.least(F.get(s, i + 1), F.get(s, i + 2)),
        )
        return let(closed, lambda c: F.when(F.size(c) > 0, c).otherwise(every))

    return let(pairs, choose)


def _hash_at(h: Column, i: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*[F.get(h, i + j) for j in range(WORDS)]), 32)


def anchors(text: Column) -> Column:
    """``array<struct<word, hash>>``: where an anchor begins (counted in words) and its 32-bit hash.  A text of
    fewer than five words is one anchor."""
    short = F.array(F.struct(F.lit(0).alias("word"), F.shiftrightunsigned(F.xxhash64(text), 32).alias("hash")))
    return let(
        _word_hashes(text),
        lambda h: F.when(F.size(h) < WORDS, short).otherwise(
            F.transform(_chosen(h), lambda i: F.struct(i.cast("int").alias("word"), _hash_at(h, i).alias("hash")))
        ),
    )


def coded(text: Column) -> Column:
    """The anchors as ``array<bigint>``: hash, then 31 bits of position."""
    return F.transform(anchors(text), lambda x: F.shiftleft(x["hash"], 31) + x["word"])


def sketch(a: Column) -> Column:
    """The 64 smallest different hashes of coded anchors, ascending."""
    return F.slice(F.sort_array(F.array_distinct(F.transform(a, lambda x: F.shiftright(x, 31)))), 1, KEPT)


def shown(s: Column) -> Column:
    return F.lower(F.array_join(F.transform(s, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def _offsets(a: Column, b: Column, first: bool) -> Column:
    """How far each common hash lies further on in ``b``, by its first places in both or its last ones.

    Sorted by hash, then text, the last entry of ``a`` stands before the first of ``b``; places are counted
    down where the other end is meant."""
    turned = lambda place, down: F.lit(_PLACE) - place if down else place
    place = lambda x: x.bitwiseAND(F.lit(_PLACE))
    key = lambda x, side, down: F.shiftleft(F.shiftright(x, 31), 32) + F.lit(side << 31) + turned(place(x), down)
    both = F.concat(F.transform(a, lambda x: key(x, 0, first)), F.transform(b, lambda x: key(x, 1, not first)))

    def met(s: Column) -> Column:
        group = lambda i: F.shiftright(F.get(s, i), 31)
        here = lambda i: (group(i) == group(i - 1) + 1) & (group(i).bitwiseAND(F.lit(1)) == 1)
        return F.transform(
            F.filter(F.sequence(F.lit(1), F.size(s) - 1), here),
            lambda i: turned(place(F.get(s, i)), not first) - turned(place(F.get(s, i - 1)), first),
        )

    return let(F.sort_array(both), met)


def likeness(a: Column, b: Column) -> Column:
    """Share of coded anchors with equal hash and place, ``a`` moved by the offset most common hashes agree on (of
    several the nearest to 0)."""

    def commonest(o: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(o) - 1), lambda i: (i == 0) | (F.get(o, i) != F.get(o, i - 1)))
        runs = lambda t: F.transform(
            t,
            lambda i, k: F.struct(
                (F.coalesce(F.get(t, k + 1), F.size(o)) - i).alias("n"), (-F.abs(F.get(o, i))).alias("near"), F.get(o, i).alias("by")
            ),
        )
        return let(starts, lambda t: F.array_max(runs(t))["by"])

    def share(by: Column) -> Column:
        moved = F.transform(F.filter(a, lambda x: x.bitwiseAND(F.lit(_PLACE)) + by >= 0), lambda x: x + by)
        return let(F.size(F.array_intersect(moved, b)), lambda n: n / (F.size(a) + F.size(b) - n))

    offsets = F.sort_array(F.concat(_offsets(a, b, True), _offsets(a, b, False)))
    return let(offsets, lambda o: F.when(F.size(o) == 0, F.lit(0.0)).otherwise(let(commonest(o), share)))


def _bounds(ids: DataFrame, buckets: int) -> list[int]:
    """Ids that cut the table into about equal parts, the smallest first."""
    if buckets == 1:
        cuts = []
    else:
        cuts = ids.agg(F.percentile_approx("x", [j / buckets for j in range(1, buckets)], 10 * buckets)).first()[0] or []
    least = ids.agg(F.min("x")).first()[0]
    return [] if least is None else sorted({least, *cuts})


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_chars, fingerprint, the same of its edited text (its last half replaced by the
    beginning of the next document by id), and the likeness to the edited text and to the next document, from all
    anchors.

    Null text counts as empty; a text of fewer than five words has one anchor.  Rows without id come first;
    rows with equal ids follow each other by hash and text.  The document after the last is the first, also for
    a table of one row.  Empty table: no rows.  Other columns are ignored, whatever their names.

    Neighbours meet without a global order: ranges of ids, cut at sampled ids, are sorted apart, and the
    first rows of a range also go to the range before it.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    x = F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LEAST))
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(docs.select(x.alias("x")), buckets)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), x.alias("x"), text.alias("text"))
    starts = F.array(*[F.lit(b) for b in bounds or [_LEAST]])
    own = range_bucket(F.col("x"), bounds or [_LEAST])
    before = lambda b: F.pmod(b - 1, F.lit(max(1, len(bounds))))
    mark = lambda b, extra: F.struct(b.cast("int").alias("bucket"), F.lit(extra).alias("extra"))
    places = let(
        own,
        lambda b: F.when(F.get(starts, b) == F.col("x"), F.array(mark(b, False), mark(before(b), True))).otherwise(
            F.array(mark(b, False))
        ),
    )
    rows = rows.select("*", F.explode(places).alias("p")).select("*", "p.bucket", "p.extra").drop("p")
    order = W.partitionBy("bucket").orderBy("extra", "x", F.xxhash64("text"), "text")
    rows = rows.select(
        "doc_id",
        "text",
        "extra",
        F.lead("text").over(order).alias("next_text"),
    ).filter(~F.col("extra"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(
        F.expr("substring(text, 1, cast(length(text) - floor(length(text) / 2) as int))"),
        F.substring(F.col("next_text"), F.lit(1), half),
    )
    rows = rows.withColumn("edited", edited)
    rows = rows.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        coded(F.col("text")).alias("own"),
        coded(F.col("next_text")).alias("next"),
        coded(F.col("edited")).alias("changed"),
    )
    return rows.select(
        F.col("doc_id").alias(id_col),
        "n_chars",
        "edited_sha256",
        shown(sketch(F.col("own"))).alias("fingerprint"),
        shown(sketch(F.col("changed"))).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
