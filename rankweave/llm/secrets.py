"""Secret scan over content-addressed versions: a blob is scanned once per rule version, whatever its paths.

A version is a row (path, text).  Its blob is the SHA-256 of the text.  The ledger holds one row per blob and
rule version that was ever scanned, with the findings.  A scan takes the blobs that lack a row for some rule
version, reads each of them once, adds ledger rows, and joins all findings back to every path.

Copies collapse before the shuffle; the join back to a blob with very many paths is an ordinary equi-join whose
large side Spark can split.  All work is column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.columns import no_spans, spans
from rankweave.operators.numbering import durable


@dataclass(frozen=True)
class Rule:
    """``pattern`` is tried where ``gate`` holds for the text; ``keep`` judges a match by itself and its group."""

    kind: str
    version: int
    pattern: str
    gate: Callable[[Column], Column]
    keep: Callable[[Column, Column], Column] = lambda m, g: F.lit(True)
    group: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}/{self.version}"


def _any(*parts: str) -> Callable[[Column], Column]:
    def gate(text: Column) -> Column:
        low = F.lower(text)
        found = low.contains(parts[0])
        for p in parts[1:]:
            found = found | low.contains(p)
        return found

    return gate


def _has(part: str) -> Callable[[Column], Column]:
    return lambda text: text.contains(part)


# The three base kinds in the order they are listed, then the kinds this scan adds.
ASSIGN = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
BASE_RULES = (
    Rule("assign", 1, ASSIGN, _any("passw", "secret", "token", "key"), lambda m, g: F.length(g) >= 6, 1),
    Rule("access", 1, r"AKIA[A-Z0-9]+", _has("AKIA"), lambda m, g: F.length(m) >= 20),
    # Runs shorter than 24 are no findings and nothing depends on them, so they are not matched at all.
    Rule("hex", 1, r"[0-9a-f]{24,}", lambda text: text.rlike(r"[0-9a-f]{24}")),
)
ADDED_RULES = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", _has("PRIVATE KEY-----")),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", _has("eyJ")),
    Rule("github", 1, r"gh[opsu]_[A-Za-z0-9]{36,}", lambda text: text.rlike("gh[opsu]_")),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", _has("xox")),
    Rule("google", 1, r"AIza[A-Za-z0-9_-]{35}", _has("AIza")),
)
RULES = BASE_RULES + ADDED_RULES
LEDGER = "blob string, rule string, findings array<struct<start:int,end:int,kind:string>>"


def blobs(versions: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """``(path, blob, text)``; null text counts as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return versions.select(F.col(path_col).alias("path"), F.sha2(text.cast("binary"), 256).alias("blob"), text.alias("text"))


def scan_unseen(found: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """New ledger rows: every blob of ``found`` by every rule version the ledger does not know for it."""
    texts = found.select("blob", "text")
    names = F.array(*[F.lit(r.name) for r in rules])
    if ledger is None:
        todo = texts.dropDuplicates(["blob"]).withColumn("seen", F.array().cast("array<string>"))
    else:
        done = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        todo = (
            texts.join(done, "blob", "left")
            .withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
            .filter(F.size(F.array_except(names, "seen")) > 0)
            .dropDuplicates(["blob"])
        )
    text = F.col("text")
    rows = F.array(
        *[
            F.when(
                ~F.array_contains("seen", r.name),
                F.struct(
                    F.lit(r.name).alias("rule"),
                    F.when(r.gate(text), spans(text, r.pattern, r.kind, r.keep, r.group)).otherwise(no_spans()).alias("findings"),
                ),
            )
            for r in rules
        ]
    )
    return todo.select("blob", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("r")).select("blob", "r.rule", "r.findings")


def scan(
    versions: DataFrame,
    ledger: DataFrame | None = None,
    rules: Sequence[Rule] = RULES,
    path_col: str = "path",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """``(findings, new ledger rows)``: findings are ``(path, blob, findings)``, one row per version, found by
    the given rule versions, sorted by start and then by the order of the rules.

    The new rows are written to the shared folder; add them to the ledger to skip those blobs next time.
    Null text counts as empty.  Rows with equal text share a blob, rows with equal path stay apart.  Empty
    table: no rows in either.  Other columns are ignored, whatever their names.
    """
    found = blobs(versions, path_col, text_col)
    new = durable(scan_unseen(found, ledger, rules), "ledger")
    known = new if ledger is None else new.unionByName(ledger.select("blob", "rule", "findings"))
    hits = known.filter(F.col("rule").isin([r.name for r in rules]) & (F.size("findings") > 0))
    hits = hits.groupBy("blob").agg(F.flatten(F.collect_list("findings")).alias("findings"))
    place = F.array(*[F.lit(r.kind) for r in rules])
    ordered = F.transform(
        F.sort_array(
            F.transform("findings", lambda x: F.struct(x["start"], F.array_position(place, x["kind"]).alias("k"), x["end"], x["kind"]))
        ),
        lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")),
    )
    hits = hits.select("blob", ordered.alias("findings"))
    joined = found.select("path", "blob").join(hits, "blob", "left")
    return joined.select("path", "blob", F.coalesce("findings", no_spans()).alias("findings")), new


def listed(findings: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, SHA-256 of the listed base findings, all findings."""
    found, _ = scan(docs, None, RULES, id_col, text_col)
    base = F.filter("findings", lambda x: x["kind"].isin([r.kind for r in BASE_RULES]))
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("bigint")
    return found.select(
        F.col("path").alias(id_col),
        *[count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("findings")).alias("spans"),
    )


def _oracle() -> str:
    rows = []
    for at, r in enumerate(RULES, 1):
        pattern = r.pattern.replace("(?i:", "(?:(?i)").replace("'", "''")
        keep = {"assign": "length(g) >= 6", "access": "length(m) >= 20"}.get(r.kind, "true")
        rows.append(
            f"""SELECT doc_id, row, '{r.kind}' kind, {at} k, s AS start, s + length(m) AS stop FROM (
  SELECT doc_id, row, m, g, coalesce(sum(length(gap)) OVER w, 0)
         + coalesce(sum(length(m)) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) s
  FROM (SELECT doc_id, row, unnest(regexp_extract_all(t, '{pattern}')) m,
               unnest(regexp_extract_all(t, '{pattern}', {r.group})) g,
               unnest(string_split_regex(t, '{pattern}')) gap, unnest(range(100000)) i
        FROM d WHERE regexp_matches(t, '{pattern}')) x
  WHERE m IS NOT NULL WINDOW w AS (PARTITION BY row ORDER BY i ROWS UNBOUNDED PRECEDING)) y WHERE {keep}"""
        )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') t, row_number() OVER () row FROM documents),
f AS ({" UNION ALL ".join(rows)}),
b AS (SELECT row, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) s,
             count(*) FILTER (kind = 'assign') a, count(*) FILTER (kind = 'access') c, count(*) FILTER (kind = 'hex') h
      FROM f WHERE k <= 3 GROUP BY row),
e AS (SELECT row, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) s FROM f GROUP BY row)
SELECT doc_id, CAST(coalesce(a, 0) AS BIGINT) n_assign, CAST(coalesce(c, 0) AS BIGINT) n_access,
       CAST(coalesce(h, 0) AS BIGINT) n_hex, sha256(coalesce(b.s, '')) base_sha256, coalesce(e.s, '') spans
FROM d LEFT JOIN b USING (row) LEFT JOIN e USING (row)"""


ORACLE = _oracle()
