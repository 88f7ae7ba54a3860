"""Personal data against Python's own regular expressions."""

import hashlib
import re

from docs_fixture import docs, none, rows

from quarry.llm import pii, queries

SF = "/root/testdata/sf0.001"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        luhn = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and luhn % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    found = [(m.start(), no, k, m.end()) for no, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if good(k, m.group())]
    return [(k, s, e) for s, _, k, e in sorted(found)]


def test_base_spans(spark):
    hard = "a.b@c.d_e@f.g x@y @z.a %+-@a-.b 1.2.3.4.5.6.7.8 0000255.0.0.256 01.02.03.0000255 4111111111111111 4111 1111 1111 1111 5500-0000-0000-0004 +1--2 +1 (234) 555-0100) 12+345678901+2"
    more = spark.createDataFrame([(900, hard), (901, "é" * 9 + hard + "\U0001f600 " + hard), (902, "9" * 60_000 + " " + "a." * 30_000)], "doc_id long, text string")
    got = pii.find(docs(spark).select("doc_id", "text").unionByName(more)).collect()
    want = {r[0]: r[1] for r in rows() if r[0] is not None} | {r["doc_id"]: r["text"] for r in more.collect()}
    assert len(got) == len(rows()) + 3
    for r in got:
        if r["doc_id"] is not None:
            assert [(s["kind"], s["start"], s["end"]) for s in r["base"]] == base(want[r["doc_id"]])
        assert all(s in r["spans"] for s in r["base"])


def test_patterns_discover_unseen_identifiers(spark):
    seen = [(i, f"word{chr(97 + i % 7)} mailto: user{i}@host{i}.example.org the other words and more") for i in range(12)]
    unseen = [(50, "text mailto: user99(at)host then"), (51, "the 12345 and the 777")]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(seen + unseen, "doc_id long, text string")).collect()}
    assert [(s["kind"], s["start"], s["end"]) for s in got[50]["spans"]] == [("context", 13, 27)]
    assert got[51]["spans"] == []
    assert all(got[i]["base"] == got[i]["spans"] for i, _ in seen)


def test_empty(spark):
    assert pii.find(none(spark)).count() == 0


def test_query(spark):
    table = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op8_bootstrapped_pii"](spark, SF).collect()
    assert len(got) == len(table)
    for r in got:
        want = base(table[r["doc_id"]])
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(x[0] == k for x in want) for k in PLAIN]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
