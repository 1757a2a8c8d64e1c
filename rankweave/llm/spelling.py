"""Group spelling variants: words one edit apart, found by asymmetric q-chunks.

A word of L code points contributes two disjoint chunks that cover it, its first half and the rest.  One inserted,
deleted or replaced code point lies in one of them, so the other chunk is a positional gram of the near word, at its
own place or shifted by one.  The same holds once more inside the chunk with the edit: it is two disjoint chunks
again, one of which is kept within shift one.  A chunk and the kept half of the other one are a join key together, all
of the word but one quarter, so that no key is shared by very many words, however common its chunks are.

Of the positional grams of the other word only those are made that such a key can meet.  The longer word of a pair (of
equal length: the larger one) plays this part; grams behind the edit are read from its end, which is the
shift.  Keys are joined by equality and the join itself verifies the pair, so that candidates are not written.  The
quarters in which an edit can lie are neighbours; a pair is taken at the first of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.operators.numbering import durable

RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(word: Column) -> Column:
    """A-Z as a-z; all else stays.  ``lower`` does the same for words of one byte a code point, and is faster."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(F.translate(word, CAPITALS, SMALL))


def slipped(word: Column, name: Column, every: int) -> Column:
    """``word`` without one code point if ``every`` divides the crc32 of ``name``: a reproducible slip of the pen."""
    h = F.crc32(name.cast("binary"))
    at = (h % F.length(word)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def vocabulary(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``(word, n)`` of the column ``word``: words of enough code points that occur often enough."""
    found = words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return found.filter(F.col("n") >= least_count)


def _quarters(size: Column) -> list[tuple[Column, Column]]:
    """Start and end of the quarters of a word of ``size`` code points: the halves of its two chunks."""
    half = F.floor(size / 2)
    cuts = [F.lit(0), F.floor(half / 2), half, half + F.floor((size - half) / 2), size]
    return [(a.cast("int"), b.cast("int")) for a, b in zip(cuts, cuts[1:], strict=False)]


def _keys(words: DataFrame, longer: bool) -> DataFrame:
    """``(size, start, key)`` and the word: the chunks of a word without one quarter, or the grams of a word that
    such chunks of words of ``size`` code points can meet."""
    length = F.length("word")
    rows = words.withColumn("size", F.explode(F.array(length, length - 1)) if longer else length)
    size, word = F.col("size"), F.col("word")
    # Very short words have empty quarters, whose edits lie at the edge of another one too.
    keys = [
        F.when(a < b, F.struct(a.alias("start"), F.concat_ws(" ", F.left(word, a), F.right(word, size - b)).alias("key")))
        for a, b in _quarters(size)
    ]
    rows = rows.withColumn("k", F.explode(F.array(*keys))).filter(F.col("k").isNotNull())
    return rows.select("size", "k.start", "k.key", "word", "n")


def near_pairs(words: DataFrame) -> DataFrame:
    """``(a, na, b, nb)``: every pair of different words one edit apart once, ``a`` the shorter or, of equal length,
    the smaller one.  ``words`` has distinct words, without spaces, and their counts."""
    short = _keys(words, False).select("size", "start", "key", F.col("word").alias("a"), F.col("n").alias("na"))
    long = _keys(words, True).select("size", "start", "key", F.col("word").alias("b"), F.col("n").alias("nb"))
    once = (F.length("b") > F.col("size")) | (F.col("a") < F.col("b"))
    # An edit that fits the quarter before as well was met there.
    behind = F.col("size") - F.col("start")
    first = (F.col("start") == 0) | (F.right("a", behind) != F.right("b", behind))
    pairs = short.join(long, ["size", "start", "key"]).filter(once & first & (F.levenshtein("a", "b", 1) == 1))
    return pairs.select("a", "na", "b", "nb")


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for words with a form: the end of the chain of forms, by doubling the steps.

    A form occurs at least twice as often as its word, so chains end after the logarithm of the largest count,
    and the rounds after the logarithm of that.
    """
    now = durable(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = durable(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = stepped.select("word", "root")
        if stepped.filter("moved").isEmpty():
            return now


def group(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for distinct words with counts.

    ``n_near`` counts the words one edit apart.  ``form`` is the one of them with the largest count, of equal counts the
    smallest in code points, if it occurs at least ``ratio`` times as often; else null.  ``root`` is where the forms
    lead to, the word itself without a form.  Empty table: no rows.
    """
    pairs = durable(near_pairs(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("na").alias("n"), F.col("b").alias("other"), F.col("nb").alias("m"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("nb").alias("n"), F.col("a").alias("other"), F.col("na").alias("m")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    known = words.join(best, "word", "left")
    strong = -F.col("best.less") >= F.col("n") * ratio
    known = known.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(strong, F.col("best.other")).alias("form"),
        F.when(strong, -F.col("best.less")).alias("form_n"),
    )
    known = durable(known, "forms")
    roots = _roots(known.filter(F.col("form").isNotNull()))
    out = known.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def corpus_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int | None = None) -> DataFrame:
    """The column ``word``: the runs of letters of all texts, A-Z lower-cased, with slips if ``every`` is given.

    Null text: no words.  A null id counts as an empty one in the name that decides on a slip.
    """
    runs = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(RUN), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("id", lowered(F.col("run")).alias("word"))
    if every is None:
        return rows.select("word")
    return rows.select(slipped(F.col("word"), F.concat("id", F.lit(":"), "word"), every).alias("word"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int | None = None) -> DataFrame:
    """``group`` of the words of all texts that have enough code points and occur often enough.

    Texts are read whole, whatever their length; null and empty ones have no words; repeated rows count as often as
    they stand there; a table without such words gives no rows.  Other columns are ignored.
    """
    return group(durable(vocabulary(corpus_words(docs, id_col, text_col, every)), "vocabulary"))


def digest(docs: DataFrame) -> DataFrame:
    """The rows of the registered query."""
    return variants(docs, every=97)


# The crc32 byte by byte from its table; pairs by deleted code points: words that differ by one replacement give the
# same rest at the same place, and the longer word of an insertion gives the shorter one.
ORACLE = rf"""
WITH RECURSIVE bits AS (
  SELECT list(list_reduce(list_prepend(CAST(i AS BIGINT), [CAST(1 AS BIGINT) for k in range(8)]),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) tab FROM range(256) t(i)),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), '{CAPITALS}', '{SMALL}') run FROM documents),
named AS (SELECT doc_id, run, count(*) n, hex(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run) hx FROM runs GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
      list_prepend(4294967295, [CAST(16 * (instr('0123456789ABCDEF', hx[2*k+1]) - 1) + instr('0123456789ABCDEF', hx[2*k+2]) - 1 AS BIGINT)
                                for k in range(length(hx) // 2)]),
      lambda s, b: xor(s >> 8, tab[(xor(s, b) & 255) + 1]))) h
  FROM named, bits),
v AS (
  SELECT word, CAST(sum(n) AS BIGINT) n FROM (
    SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END word
    FROM hashed) WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) i FROM v),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) rest FROM places),
longer AS (SELECT DISTINCT c.word, c.n, v.word other, v.n m FROM cut c JOIN v ON c.rest = v.word),
near AS (
  SELECT a.word, b.word other, b.n m FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION ALL SELECT word, other, m FROM longer
  UNION ALL SELECT other, word, n FROM longer),
best AS (
  SELECT word, count(*) n_near, first(other ORDER BY m DESC, other) other, max(m) m FROM near GROUP BY word),
f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) n_near, CASE WHEN m >= {RATIO} * n THEN other END form, CASE WHEN m >= {RATIO} * n THEN m END form_n
  FROM v LEFT JOIN best USING (word)),
chain AS (
  SELECT word, form root FROM f WHERE form IS NOT NULL
  UNION ALL SELECT c.word, f.form FROM chain c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL),
last AS (SELECT c.word, c.root FROM chain c JOIN f ON f.word = c.root WHERE f.form IS NULL)
SELECT word, form, coalesce(root, word) root, n, CAST(n_near AS BIGINT) n_near, form_n FROM f LEFT JOIN last USING (word)"""
