"""Registered queries for V1–V7 with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import reconcile as V
from quarry.plans.registry import query
from quarry.sources.views import Views

_EXP = "SELECT o_orderpriority, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1"
_ACT = f"""SELECT o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN total + 0.0000001 WHEN '2-HIGH' THEN total + 1.0 WHEN '3-MEDIUM' THEN total + 0.04 ELSE total END AS total
 FROM ({_EXP}) WHERE o_orderpriority <> '5-LOW' UNION ALL SELECT 'X-EXTRA', 1.0"""


def _pair(spark, sf_dir):
    o = Views(spark, sf_dir).orders
    exp = o.groupBy("o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    p = F.col("o_orderpriority")
    t = F.col("total")
    act = exp.where(p != "5-LOW").select(
        p, F.when(p == "1-URGENT", t + 0.0000001).when(p == "2-HIGH", t + 1.0).when(p == "3-MEDIUM", t + 0.04).otherwise(t).alias("total")
    )
    act = act.unionByName(spark.createDataFrame([("X-EXTRA", 1.0)], "o_orderpriority string, total double"))
    return exp, act


def _recon_sql(cond: str) -> str:
    return f"""SELECT coalesce(e.o_orderpriority, a.o_orderpriority) AS o_orderpriority, round(e.total, 2) AS expected, round(a.total, 2) AS actual,
 CASE WHEN a.total IS NULL AND e.total IS NOT NULL THEN 'missing_actual' WHEN e.total IS NULL AND a.total IS NOT NULL THEN 'unexpected'
 WHEN {cond} THEN 'match' ELSE 'mismatch' END AS status
FROM ({_EXP}) e FULL OUTER JOIN ({_ACT}) a ON e.o_orderpriority = a.o_orderpriority"""


def _rounded(df):
    return df.withColumn("expected", F.round("expected", 2)).withColumn("actual", F.round("actual", 2))


@query("v1_reconcile_exact", _recon_sql("abs(a.total - e.total) < 0.000001"))
def v1_reconcile_exact(spark, sf_dir):
    """Expected vs perturbed order totals, exact (1e-6)."""
    e, a = _pair(spark, sf_dir)
    return _rounded(V.reconcile_exact(e, a, ["o_orderpriority"], "total"))


@query("v2_reconcile_tolerance", _recon_sql("abs(a.total - e.total) <= greatest(0.05, abs(e.total) * 0.001)"))
def v2_reconcile_tolerance(spark, sf_dir):
    """Expected vs perturbed order totals within max(0.05, 0.1 %)."""
    e, a = _pair(spark, sf_dir)
    return _rounded(V.reconcile_tolerance(e, a, ["o_orderpriority"], "total"))


@query(
    "v3_any_row_contains",
    """WITH ex(exp_id, "column", value) AS (VALUES (1, 'n_name', 'NATION_1'), (1, 'n_regionkey', (SELECT CAST(n_regionkey AS VARCHAR) FROM nation WHERE n_name = 'NATION_1')),
 (2, 'n_name', 'NATION_2'), (2, 'n_regionkey', '99'), (3, 'n_name', 'NATION_24'))
SELECT exp_id, bool_or(ok) AS found FROM (SELECT e.exp_id, n.n_nationkey, count(*) = (SELECT count(*) FROM ex x WHERE x.exp_id = e.exp_id) AS ok
 FROM ex e JOIN (SELECT n_nationkey, 'n_name' AS "column", n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'n_regionkey', CAST(n_regionkey AS VARCHAR) FROM nation
 UNION ALL SELECT n_nationkey, 'n_nationkey', CAST(n_nationkey AS VARCHAR) FROM nation) l ON e."column" = l."column" AND e.value = l.value GROUP BY e.exp_id, n.n_nationkey) q
 RIGHT JOIN (SELECT DISTINCT exp_id FROM ex) USING (exp_id) GROUP BY exp_id""".replace("n.n_nationkey", "l.n_nationkey"),
)
def v3_any_row_contains(spark, sf_dir):
    """Expectation sets found in any nation row (semi-join of pairs)."""
    n = Views(spark, sf_dir).nation
    region1 = n.where(F.col("n_name") == "NATION_1").select(F.lit(1).alias("exp_id"), F.lit("n_regionkey").alias("column"), F.col("n_regionkey").cast("string").alias("value"))
    fixed = spark.createDataFrame(
        [(1, "n_name", "NATION_1"), (2, "n_name", "NATION_2"), (2, "n_regionkey", "99"), (3, "n_name", "NATION_24")], "exp_id int, column string, value string"
    )
    return V.any_row_contains(n, "n_nationkey", fixed.unionByName(region1))


@query(
    "v4_number_in_text",
    """SELECT doc_id, coalesce(list_bool_or(list_transform(regexp_extract_all(text, '-?[0-9]+(?:,[0-9][0-9][0-9])*(?:[.][0-9]+)?(?:[eE][+-]?[0-9]+)?'), lambda s: abs(TRY_CAST(replace(s, ',', '') AS DOUBLE) - 100) <= 5)), false) AS mentions FROM documents""",
)
def v4_number_in_text(spark, sf_dir):
    """Does each document mention a number within 5 of 100 (whole text)."""
    d = Views(spark, sf_dir).documents
    return d.select("doc_id", V.number_in_text(F.col("text"), F.lit(100.0), 5.0).alias("mentions"))


_KW = ["the", "and", "license", "Copyright"]


@query(
    "v5_keyword_coverage",
    "SELECT doc_id, array_to_string(list_filter(['the', 'and', 'license', 'Copyright'], lambda k: NOT coalesce(contains(text, k), false)), '|') AS missing FROM documents",
)
def v5_keyword_coverage(spark, sf_dir):
    """Required keywords missing from each document."""
    d = Views(spark, sf_dir).documents
    return d.select("doc_id", F.array_join(V.keyword_coverage(F.col("text"), _KW), "|").alias("missing"))


@query(
    "v6_completeness_check",
    """WITH e AS (SELECT o_orderkey, count(*) AS expected_count FROM (SELECT o_orderkey, unnest(range(0, 1 + CAST(o_orderkey % 7 AS BIGINT))) FROM orders) GROUP BY 1),
a AS (SELECT l_orderkey AS o_orderkey, count(*) AS actual_count FROM lineitem GROUP BY 1)
SELECT e.o_orderkey, expected_count, coalesce(actual_count, 0) AS actual_count, 'warning' AS severity FROM e LEFT JOIN a ON e.o_orderkey = a.o_orderkey
WHERE coalesce(actual_count, 0) < expected_count""",
)
def v6_completeness_check(spark, sf_dir):
    """Orders expecting 1 + key % 7 lines with fewer lines present."""
    v = Views(spark, sf_dir)
    exp = v.orders.select("o_orderkey", F.explode(F.sequence(F.lit(0), (F.col("o_orderkey") % 7).cast("int"))).alias("_i"))
    act = v.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    return V.completeness_check(exp, act, "o_orderkey")


@query(
    "v7_evidence_filter",
    """WITH f AS (SELECT d.doc_id, d.source, CASE WHEN l.quality = 1 THEN 'quality label' ELSE '' END AS evidence FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT source, count(*) AS findings, count_if(length(evidence) > 0) AS kept, count_if(length(evidence) > 0) = 0 AS warning FROM f GROUP BY source""",
)
def v7_evidence_filter(spark, sf_dir):
    """Findings per source kept only with evidence; warn when none remain."""
    v = Views(spark, sf_dir)
    f = v.documents.join(v.labels, "doc_id", "left").select(
        "doc_id", "source", F.when(F.col("quality") == 1, "quality label").otherwise("").alias("evidence")
    )
    return V.evidence_filter(f, "source", "evidence")[1]
