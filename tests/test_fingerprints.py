"""Repeated rows by fingerprint, also where fingerprints collide."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import fingerprints
from quarry.operators import quality as Q

ROWS = [(1, None, "a"), (1, "a", None), (1, None, "a"), (2, "x", "y"), (2, "x", "y"), (2, "x", "y"), (3, "", ""), (3, None, None), (None, None, None), (None, None, None)]


@pytest.fixture(params=["hashes", "all collide"])
def table(request, spark, monkeypatch):
    if request.param == "all collide":
        same = lambda cols: [F.lit(7).cast("long").alias(p) for p in fingerprints.PRINT]
        monkeypatch.setattr(fingerprints, "fingerprint", same)
        monkeypatch.setattr(Q, "fingerprint", same)
    return spark.createDataFrame(ROWS, "k int, a string, b string")


def test_repeated_rows(table):
    got = {(r["k"], r["a"], r["b"]): r["_n"] for r in fingerprints.repeated_rows(table).collect()}
    assert got == {(1, None, "a"): 2, (2, "x", "y"): 3, (None, None, None): 2}
    assert fingerprints.repeated_rows(table.limit(0)).count() == 0


def test_audit_counts_and_lists_whole_rows(table):
    first = Q.quality_issues(table).where("issue_type = 'duplicate_rows'").first()
    assert (first["affected"], first["detail"]) == (4, "__row__: 4 rows repeat an earlier row")
    listed = Q.quality_detail_rows(table, ["k"])
    assert listed.columns == ["issue_position", "issue_type", "k", "a", "b"]
    assert sorted(map(str, [tuple(r)[2:] for r in listed.collect()])) == sorted(str(r) for r in ROWS if ROWS.count(r) > 1)
    one = Q.audit_metrics(table).first()
    assert (one["row_count"], one["column_count"], one["duplicate_count"], one["detail_row_count"]) == (10, 3, 4, 7)


def test_a_table_without_issues_says_so(spark):
    rows = Q.quality_issues(spark.createDataFrame([(1, "a"), (2, "b")], "k int, a string")).collect()
    assert [(r["issue_type"], r["affected"], r["detail"]) for r in rows] == [("no_issue", 0, "__dataset__: 0 issues found")]
