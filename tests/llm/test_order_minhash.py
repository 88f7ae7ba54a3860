"""Order MinHash against a plain version of its definition."""

import hashlib

from docs_fixture import docs, none, rows

from quarry.llm import order_minhash as om
from quarry.llm import queries

SF = "/root/testdata/sf0.001"


def edited(table):
    order = sorted(table, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()), reverse=True)
    out = []
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        n = len(text) // 3
        out.append((doc, text, text[: len(text) - n] + after[:n], after))
    return out


def check(got, table):
    want = edited(table)
    assert len(got) == len(want)
    left = sorted((str(d), len(t), hashlib.sha256(e.encode()).hexdigest()) for d, t, e, _ in want)
    assert sorted((str(r["doc_id"]), r["n"], r["sha"]) for r in got) == left
    by_text = {}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        for text, fp in ((r["text"], r["fingerprint"]), (r["edited"], r["edited_fingerprint"])):
            assert by_text.setdefault(text, fp) == fp
        if r["text"] == r["edited"]:
            assert r["near_edited"] == 1.0


def view(df):
    from pyspark.sql import functions as F

    return df.withColumn("n", F.length("text")).withColumn("sha", F.sha2("edited", 256)).collect()


def test_edited_texts_and_fingerprints(spark):
    check(view(om.compare_edited(docs(spark))), [(r[0], r[1]) for r in rows()])


def test_few_rows(spark):
    assert om.compare_edited(none(spark)).count() == 0
    one = spark.createDataFrame([(5, "a b c d e f g")], "doc_id long, text string")
    check(view(om.compare_edited(one)), [(5, "a b c d e f g")])


def test_many_blocks(spark):
    table = [(i * i - 50, f"{i} " * (i % 40) + "end") for i in range(700)] + [(None, f"n{i}") for i in range(3)]
    check(view(om.compare_edited(spark.createDataFrame(table, "doc_id long, text string"))), table)


def test_occurrences_and_order_count(spark):
    def alike(a, b):
        df = spark.createDataFrame([(a, b)], "a string, b string")
        return om.fingerprint(om.fingerprint(df, "a", "x"), "b", "y").select(om.likeness("x", "y")).first()[0]

    halves = [" ".join(f"w{i}{j}" for j in range(300)) for i in range(2)]
    # the same words, moved: a set of k-mers hardly changes, the order of tuples does
    assert alike(" ".join(halves), " ".join(halves)) == 1.0
    assert alike(" ".join(halves), " ".join(reversed(halves))) < 0.75
    assert alike(" ".join(halves), " ".join(halves) + " more") > 0.9
    assert alike("a b c " * 200, "a b c " * 20) < 0.5  # repeats are numbered
    assert alike(halves[0], halves[1]) == 0.0
    assert alike("", " \n") == 1.0 and alike("", "x") == 0.0


def test_query(spark):
    table = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in queries.QUERIES["op9_order_minhash"](spark, SF).collect()}
    for doc, text, changed, _ in edited(table):
        r = got[doc]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
    near = [r for r in got.values() if r["n_chars"] > 600]
    assert sum(r["near_edited"] > r["near_next"] for r in near) >= 0.95 * len(near)
