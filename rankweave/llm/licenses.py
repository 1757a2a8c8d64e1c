"""Licence scan by sentences: known sentences become identifiers, sequences of identifiers match ordered rules.

A text is cut into pieces at line breaks and after any of ``.!?;:``; pieces are lower-cased and stripped of marks
and comment leaders.  A run of pieces that nothing but single line breaks, ';' and ':' part and that reads as a
known sentence gets its identifier, whatever its wrapping; the others are left out.  A rule is an ordered run of identifiers; it matches where that run
stands in the sequence of the text.  All work is column expressions over one row, with the fixed sentences and
rules as constants: there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.columns import let

# Normalised licence sentences and their identifiers.
SENTENCES = {
    "released under the mit license": "mit-released",
    "licensed under the mit license": "mit-released",
    "this project is licensed under the mit license": "mit-released",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "licensed under the apache license version 2.0": "apache-2-declared",
    "licensed under the apache license version 2.0 the license": "apache-2-declared",
    "you may not use this file except in compliance with the license": "apache-2-compliance",
    "you may obtain a copy of the license at": "apache-2-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-2-as-is",
    "this work is licensed under the gnu general public license version 3": "gpl-3-declared",
    "licensed under the gnu general public license version 3": "gpl-3-declared",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3-or-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl-2-or-later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-no-warranty",
    "see the gnu general public license for more details": "gpl-details",
    "licensed under cc by nc 4.0": "cc-by-nc-4",
    "this work is licensed under cc by nc 4.0": "cc-by-nc-4",
    "licensed under cc by 4.0": "cc-by-4",
    "licensed under cc by sa 4.0": "cc-by-sa-4",
    "this work is licensed under a creative commons attribution 4.0 international license": "cc-by-4",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version": "lgpl-2.1-or-later",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl-3-or-later",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "lgpl-no-warranty",
    "see the gnu lesser general public license for more details": "lgpl-details",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl-3-or-later",
    "see the gnu affero general public license for more details": "agpl-details",
    "this source code form is subject to the terms of the mozilla public license v": "mpl-subject",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2.0": "mpl-2-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2.0": "mpl-2-copy",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "this software is provided as is without any express or implied warranty": "zlib-as-is",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "this is free and unencumbered software released into the public domain": "unlicense-released",
    "licensed under cc0 1.0": "cc0-1",
    "this work is licensed under cc0 1.0": "cc0-1",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www eclipse org legal epl 2.0": "epl-2-declared",
    "all rights reserved": "all-rights-reserved",
}

# Ordered runs of identifiers and the licence they show.
RULES = (
    ("mit", "MIT", ("mit-released",)),
    ("mit-text", "MIT", ("mit-grant", "mit-notice")),
    ("apache-2", "Apache-2.0", ("apache-2-declared",)),
    ("apache-2-header", "Apache-2.0", ("apache-2-declared", "apache-2-compliance", "apache-2-copy", "apache-2-as-is")),
    ("gpl-3", "GPL-3.0", ("gpl-3-declared",)),
    ("gpl-3-header", "GPL-3.0-or-later", ("gpl-3-or-later", "gpl-no-warranty", "gpl-details")),
    ("gpl-2-header", "GPL-2.0-or-later", ("gpl-2-or-later", "gpl-no-warranty", "gpl-details")),
    ("cc-by-nc-4", "CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("cc-by-4", "CC-BY-4.0", ("cc-by-4",)),
    ("cc-by-sa-4", "CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("bsd-2", "BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("bsd-3", "BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("lgpl-2.1-header", "LGPL-2.1-or-later", ("lgpl-2.1-or-later", "lgpl-no-warranty", "lgpl-details")),
    ("lgpl-3-header", "LGPL-3.0-or-later", ("lgpl-3-or-later", "lgpl-no-warranty", "lgpl-details")),
    ("agpl-3-header", "AGPL-3.0-or-later", ("agpl-3-or-later", "gpl-no-warranty", "agpl-details")),
    ("mpl-2-header", "MPL-2.0", ("mpl-subject", "mpl-2-copy")),
    ("isc-text", "ISC", ("isc-grant",)),
    ("zlib-text", "Zlib", ("zlib-as-is", "zlib-grant")),
    ("unlicense-text", "Unlicense", ("unlicense-released",)),
    ("cc0-1", "CC0-1.0", ("cc0-1",)),
    ("epl-2", "EPL-2.0", ("epl-2-declared",)),
    ("reserved", "Proprietary", ("all-rights-reserved",)),
)

# A piece ends at a line break, or at a mark before white space.  A known sentence may run over several pieces.
_CUT = r"[.!?;:]+(?:\s+|$)|\n+"
# Comment leaders that are words; the others are marks.
_LEADER = r"^(?:dnl|rem|c)(?: |$)"
Rules = Sequence[tuple[str, str, Sequence[str]]]


def _gate(sentences: Mapping[str, str]) -> str:
    """A pattern that every text with a known sentence matches: the longest word of each.  Words are not wrapped."""
    longest = sorted({max(s.split(), key=lambda w: (len(w), w)) for s in sentences})
    return "(?i)" + "|".join(w.replace(".", r"\.") for w in longest)


def knowledge(sentences: DataFrame, rules: DataFrame) -> tuple[dict[str, str], list[tuple[str, str, list[str]]]]:
    """Two small tables as what ``scan`` takes: ``(sentence, id)`` and ``(rule, license, ids)``, rules in order of name.

    Sentences are normalised; null rows are left out.  The tables hold texts of licences, thousands of rows at most;
    they become constants of the plan.
    """
    rows = sentences.filter("sentence is not null and id is not null").select(_plain(F.col("sentence")).alias("s"), "id").orderBy("s", "id")
    known = {r["s"]: r["id"] for r in rows.collect() if r["s"]}
    runs = rules.filter("rule is not null and size(ids) > 0").orderBy("rule").collect()
    return known, [(r["rule"], r["license"], list(r["ids"])) for r in runs]


def _plain(s: Column) -> Column:
    """Lower case; runs of anything but letters, digits and inner full stops become one space."""
    s = F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}.]+|\.+(?!\p{N})", " "))
    return F.regexp_replace(F.regexp_replace(s, " +", " "), _LEADER, "")


def _found(pieces: Column, cuts: Column, sentences: Mapping[str, str]) -> Column:
    """Known sentences among the pieces; ``cuts`` are the separators behind them."""
    # What a run of pieces that becomes a known sentence can begin with, and the most pieces it can have.
    beginnings = sorted({" ".join(k.split()[:n]) for k in sentences for n in range(1, len(k.split()) + 1)})
    most = max(len(k.split()) for k in sentences)
    broken = lambda i: F.coalesce(F.get(cuts, i), F.lit("\n")).contains("\n")
    # A mark ends a sentence unless it is a leader, i.e. no word stands between it and the cut before; so does
    # a line without words.
    ends = F.transform(
        cuts,
        lambda c, i: c.rlike(r"\n\s*\n")
        | F.when(F.get(pieces, i) == "", broken(i - 1) & c.contains("\n")).otherwise(c.rlike("[.!?]")),
    )
    worded = F.transform(pieces, lambda s, i: F.struct(i.alias("n"), s.alias("s")))
    worded = F.filter(worded, lambda x: x["s"] != "")

    def longest(w: Column, ends: Column) -> Column:
        """How many pieces from the first of ``w`` make a known sentence; null if no number does."""
        first = F.get(w, F.lit(0))["n"]
        reads = lambda j: F.concat_ws(" ", F.transform(F.slice(w, 1, j), lambda x: x["s"])).isin(list(sentences))
        whole = lambda j: ~F.exists(F.slice(ends, first + 1, F.get(w, j - 1)["n"] - first), lambda e: e)
        return F.array_max(F.filter(F.sequence(F.lit(1), F.size(w)), lambda j: reads(j) & whole(j)))

    def runs(w: Column, ends: Column) -> Column:
        starts = F.transform(w, lambda x, i: F.struct(i.alias("i"), x["n"].alias("n"), x["s"].alias("s")))
        starts = F.filter(starts, lambda x: x["s"].isin(beginnings))

        def run(x: Column) -> Column:
            window = F.slice(w, x["i"] + 1, most)
            return let(window, lambda v: let(longest(v, ends), lambda n: F.struct(
                x["i"].alias("i"), x["n"].alias("n"), (x["i"] + n).alias("end"),
                F.concat_ws(" ", F.transform(F.slice(v, 1, n), lambda y: y["s"])).alias("s"),
            )))

        return F.filter(F.transform(starts, run), lambda x: x["end"].isNotNull())

    known = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])
    # A known sentence that ends another one ("this work is" + ...) is not counted again.
    outer = lambda h: F.filter(h, lambda x, j: ~F.coalesce(F.get(h, j - 1)["end"] > x["i"], F.lit(False)))
    hits = let(ends, lambda e: let(worded, lambda w: let(runs(w, e), outer)))
    return F.transform(hits, lambda x: F.struct(x["n"].alias("sentence"), F.element_at(known, x["s"]).alias("id")))


def identified(text: Column, sentences: Mapping[str, str] = SENTENCES) -> Column:
    """``array<struct<sentence, id>>``: number of the first piece of a known sentence and its identifier."""
    cut = F.struct(
        F.transform(F.split(text, _CUT, -1), _plain).alias("pieces"),
        F.regexp_extract_all(text, F.lit(_CUT), F.lit(0)).alias("cuts"),
    )
    none = F.array().cast("array<struct<sentence:int,id:string>>")
    if not sentences:
        return none
    return F.when(text.rlike(_gate(sentences)), let(cut, lambda x: _found(x["pieces"], x["cuts"], sentences))).otherwise(none)


def matches(found: Column, rules: Rules = RULES) -> Column:
    """``array<struct<at, rule, license>>`` of the rules whose run stands among the identifiers; ``at`` is the
    number of its first sentence.  A rule is listed once per place, places first, then rules as given."""

    def of(run: Sequence[str]) -> Column:
        places = F.sequence(F.lit(0), F.size(found) - len(run))
        here = lambda i: F.array(*[F.get(found, i + j)["id"] for j in range(len(run))]) == F.array(*map(F.lit, run))
        return F.when(F.size(found) >= len(run), F.filter(places, here)).otherwise(F.array().cast("array<int>"))

    def listed(n: int, rule: str, name: str, run: Sequence[str]) -> Column:
        fixed = [F.lit(n).alias("n"), F.lit(rule).alias("rule"), F.lit(name).alias("license")]
        return F.transform(of(run), lambda i: F.struct(F.get(found, i)["sentence"].alias("at"), *fixed))

    every = [listed(n, *rule) for n, rule in enumerate(rules)]
    return F.sort_array(F.flatten(F.array(*every))) if every else F.array().cast("array<struct<at:int,n:int,rule:string,license:string>>")


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sentences: Mapping[str, str] = SENTENCES,
    rules: Rules = RULES,
) -> DataFrame:
    """One row per document: ``identifiers`` and ``rules`` as ``number:name`` lists (number of the piece from
    0), ``licenses`` the different licences in order of first appearance, ``n_sentences`` the known ones.

    ``sentences`` maps normalised sentences to identifiers, ``rules`` are (name, licence, run of identifiers); see
    ``knowledge`` for tables of them.  Null and empty texts have none.  Repeated rows give repeated rows; texts are
    read whole, whatever their length; of rules at one place the first given comes first.  Empty table: no rows.
    Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), identified(text, sentences).alias("found"))
    rows = rows.select("id", "found", F.when(F.size("found") > 0, matches(F.col("found"), rules)).alias("rules"))
    listed = lambda c, at, name: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x[at], x[name])), ",")
    nothing = F.lit("")
    return rows.select(
        F.col("id").alias(id_col),
        F.size("found").cast("bigint").alias("n_sentences"),
        listed("found", "sentence", "id").alias("identifiers"),
        F.coalesce(listed("rules", "at", "rule"), nothing).alias("rules"),
        F.coalesce(F.array_join(F.array_distinct(F.transform("rules", lambda x: x["license"])), ","), nothing).alias("licenses"),
    )


def _oracle() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(s)}, {quoted(i)})" for s, i in SENTENCES.items())
    rules = " UNION ALL ".join(
        f"SELECT row, places[i] place, {n} n, {quoted(rule)} rule, {quoted(name)} license FROM q, unnest(range(1, len(ids) + 1)) u(i) "
        f"WHERE list_slice(ids, i, i + {len(run) - 1}) = [{', '.join(map(quoted, run))}]"
        for n, (rule, name, run) in enumerate(RULES)
    )
    cut = r"[.!?;:]+(?:\s+|$)|\n+"
    return rf"""
WITH RECURSIVE known(s, id) AS (VALUES {known}),
beginnings AS (SELECT DISTINCT array_to_string(list_slice(string_split(s, ' '), 1, k), ' ') s
               FROM known, unnest(range(1, 200)) u(k) WHERE k <= len(string_split(s, ' '))),
d AS (SELECT doc_id, coalesce(text, '') t, row_number() OVER () row FROM documents),
p AS (SELECT row, unnest(string_split_regex(t, '{cut}')) s, unnest(list_append(regexp_extract_all(t, '{cut}'), NULL)) c,
             unnest(range(1000000)) i FROM d WHERE regexp_matches(t, '{_gate(SENTENCES)}')),
x AS (SELECT row, i, c, regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(lower(s) || ' ',
        '[^\p{{L}}\p{{N}}.]+', ' ', 'g'), '\.+([^\p{{N}}.])', ' \1', 'g'), ' +', ' ', 'g')), '{_LEADER}', '') s
      FROM p WHERE s IS NOT NULL),
-- Where a sentence ends: at an empty line, at a full stop behind words, at a line break behind a line of marks.
y AS (SELECT *, coalesce(lag(c) OVER (PARTITION BY row ORDER BY i), chr(10)) earlier FROM x),
e AS (SELECT row, i, s, sum(CASE WHEN c IS NULL THEN 0 WHEN regexp_matches(c, '\n\s*\n') THEN 1
             WHEN s = '' THEN CAST(contains(earlier, chr(10)) AND contains(c, chr(10)) AS INT)
             ELSE CAST(regexp_matches(c, '[.!?]') AS INT) END) OVER (PARTITION BY row ORDER BY i) ends FROM y),
w AS (SELECT row, i, s, ends, row_number() OVER (PARTITION BY row ORDER BY i) k FROM
      (SELECT row, i, s, coalesce(lag(ends) OVER (PARTITION BY row ORDER BY i), 0) ends FROM e) WHERE s <> ''),
walk AS (
  SELECT row, k a, k b, ends, s FROM w WHERE s IN (SELECT s FROM beginnings)
  UNION ALL
  SELECT walk.row, a, w.k, walk.ends, walk.s || ' ' || w.s FROM walk JOIN w ON w.row = walk.row AND w.k = walk.b + 1
  WHERE w.ends = walk.ends AND walk.s || ' ' || w.s IN (SELECT s FROM beginnings)),
runs AS (SELECT row, a, max(b) b, max_by(id, b) id FROM walk JOIN known USING (s) GROUP BY row, a),
h AS (SELECT r.row, i, id FROM (SELECT row, a, id, lag(b) OVER (PARTITION BY row ORDER BY a) before FROM runs) r
      JOIN w ON w.row = r.row AND w.k = r.a WHERE coalesce(before, 0) < a),
q AS (SELECT row, list(id ORDER BY i) ids, list(i ORDER BY i) places FROM h GROUP BY row),
m AS ({rules}),
f AS (SELECT row, license, min(place * 100 + n) place FROM m GROUP BY row, license),
a AS (SELECT row, string_agg(place || ':' || rule, ',' ORDER BY place, n) rules FROM m GROUP BY row),
l AS (SELECT row, string_agg(license, ',' ORDER BY place) licenses FROM f GROUP BY row),
k AS (SELECT row, count(*) n, string_agg(i || ':' || id, ',' ORDER BY i) identifiers FROM h GROUP BY row)
SELECT doc_id, CAST(coalesce(k.n, 0) AS BIGINT) n_sentences, coalesce(identifiers, '') identifiers,
       coalesce(rules, '') rules, coalesce(licenses, '') licenses
FROM d LEFT JOIN k USING (row) LEFT JOIN a USING (row) LEFT JOIN l USING (row)"""


ORACLE = _oracle()
