from __future__ import annotations

import hashlib
import re

from docs import TEXTS, awkward, nothing

from rankweave.llm import pii

TRICKY = [
    "a@b.c and x@y.co.uk_foo@y.com; @no.com me@nodot a@b.c@d.e 1@2.3.4",
    "ips 1.2.3.4.5.6.7.8 and 300.1.1.1 001.2.3.4 1.2.3 0000000256.1.1.1",
    "cards 4249604924884952 4249-6049 2488 4952 4249 6049 2488 4953 and 1 2 3",
    "phones +1 (979) 555-6697, +12, +1234567, +1 23-45.67(8) and +1 2345 6789 0123 4567",
    "é\U0001f600 mail: ñ.a-b%c+d@mail-1.example.com. +44 20 7946 0958 10.0.0.1",
    "+4249604924884952 x@1.2.3.4",
]


def brute(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m.group() if c.isdigit()]
        total = sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", m.start(), m.end()))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


def test_base_against_brute_force(spark):
    texts = [*TEXTS, *enumerate(TRICKY, 50)]
    rows = pii.find(awkward(spark, texts)).collect()
    want = sorted((str(i), hashlib.sha256(brute(t or "").encode()).hexdigest()) for i, t in texts)
    assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in rows) == want
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[50]["n_email"] == 5 and by_id[53]["n_phone"] == 2
    assert pii.find(nothing(spark)).count() == 0 and pii.sanitize(nothing(spark)).count() == 0


def test_a_long_run_is_linear():
    assert pii.base_spans("a" * 2_000_000 + " 1" * 3 + "1" * 1_000_000) == []


def disclosing():
    rows = [(i, f"filler number{i} words that differ{i} every time{i} here{i}") for i in range(60)]
    for i, near in enumerate(("alpha beta", "gamma delta", "kappa sigma")):
        rows.append((100 + i, f"{near} the zanzibarco office of boss@corp.com likes {near} filler words every time"))
    rows.append((200, "visit zanzibarco soon, words that every filler here has"))
    # A copied context proves nothing.
    rows += [(300 + i, "only onceword stands by lone@corp.com here") for i in range(5)]
    return rows


def test_terms_that_give_an_entity_away(spark):
    rows = {r["doc_id"]: r for r in pii.find(awkward(spark, disclosing())).collect()}
    assert "term:6:16" in rows[200]["spans"] and "term:15:25" in rows[100]["spans"]
    assert rows[300]["spans"] == "email:24:37" and rows[5]["spans"] == ""
    assert rows[100]["spans"].startswith("email:")


def test_sanitize(spark):
    df = awkward(spark, [*disclosing(), (400, None), (401, "")])
    out = pii.sanitize(df)
    assert out.columns == df.columns
    rows = {r["doc_id"]: r["text"] for r in out.collect()}
    assert rows[200].startswith("visit [TERM] soon") and rows[300] == "only onceword stands by [EMAIL] here"
    assert rows[400] is None and rows[401] == "" and len(rows) == df.select("doc_id").distinct().count()


def hot_source(times, others):
    """20 of 60 documents name one contact so many times, beside a word of their own and one that the others hold in part."""
    rows = []
    for k in range(20):
        foot = " ".join(f"x{k}n{t} footerword ask desk@example.org partword y{k}n{t}" for t in range(times))
        rows.append((k, f"lead{k} {foot}"))
    return rows + [(20 + k, f"other{k} text " + ("partword" if k < others else "")) for k in range(40)]


def test_an_entity_counts_once_in_a_document(spark):
    for times in (1, 2, 3, 4):
        rows = hot_source(times, 23)  # partword: P(t) = 43/60, so 1.4 times chance
        terms = pii.disclosing_terms(awkward(spark, rows)).terms.collect()
        assert {round(r["disclosure"], 6) for r in terms} == {1.0}
        spans = {r["doc_id"]: r["spans"] for r in pii.find(awkward(spark, rows)).collect()}
        assert spans[20] == "" and all(spans[k].count("term") == spans[0].count("term") >= times for k in range(20))


def test_one_long_text_and_an_entity_in_all(spark):
    log = " ".join(f"a{k} rootword root@example.org b{k}" for k in range(50))
    rows = [(0, log), *[(k, f"other{k} text") for k in range(1, 30)]]
    assert "term:3:11" in pii.find(awkward(spark, rows)).first()["spans"]
    rows = [(k, f"p{k} allword all@example.org q{k}") for k in range(10)]
    assert not any("term" in r["spans"] for r in pii.find(awkward(spark, rows)).collect())


def test_a_term_inside_a_long_address_is_no_finding():
    text = "write to 1.1.1.1+2.2.2.2+3.3.3.3+4.4.4.4+5.5.5.5.secretname@host.org or secretname"
    hits = [(m.start(), m.end()) for m in re.finditer("secretname", text)]
    spans = pii._all_spans(text, hits)
    assert [s for s in spans if s[0] == 4] == [(4, *hits[1])] and sum(s[0] == 1 for s in spans) >= 5
