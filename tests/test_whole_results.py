"""Results stay whole above the old limits, and nulls keep their meaning."""

import contextlib
import io as contextlib_io

import pytest
from pyspark.sql import functions as F

from quarry.operators import analysis as A
from quarry.operators import logs as O
from quarry.operators import profile as P
from quarry.operators import quality as Q
from quarry.operators import questions as R
from quarry.operators import reconcile as V
from quarry.operators import scope as S
from quarry.sources import io


def test_groups_and_months_beyond_the_old_limits(spark):
    df = spark.range(300).select(F.col("id").alias("k"), F.expr("add_months(DATE '1990-01-15', CAST(id AS INT))").alias("d"), F.lit(1.0).alias("v"))
    assert A.group_aggregate(df, "k", "v").count() == 300
    assert A.count_by_dimension(df, "k").count() == 300
    assert A.time_trend(df, "d", "v").count() == 300
    newest = [r["period"] for r in A.time_trend(df, "d", "v", limit=2).collect()]
    assert [str(x) for x in newest] == ["2014-11-01", "2014-12-01"]


def test_pages_and_caps(spark):
    df = spark.range(700).select(F.col("id").alias("k"))
    assert io.result_cap(df, ["k"]).count() == 700 and io.result_cap(df, ["k"], 500).count() == 500
    assert io.preview(df, ["k"], 150).count() == 150
    log = spark.range(900).select(F.lit(1).alias("task_id"), F.col("id").alias("sequence_id"))
    assert O.replay_from_cursor(log, 1, -1, None).count() == 900 and O.replay_from_cursor(log, 1, 100, 600).count() == 600
    tasks = spark.range(250).select(F.lit("t").alias("tenant_id"), F.lit("2024-01-01").alias("updated_at"), F.col("id").alias("task_id"))
    seen, after = [], None
    while page := O.task_listing(tasks, "t", 100, after).collect():
        seen += [r["task_id"] for r in page]
        after = (page[-1]["updated_at"], page[-1]["task_id"])
    assert seen == list(range(250))


def test_every_issue_keeps_its_rows(spark):
    rows = [(i % 60, None, 1.0, -5.0) for i in range(120)]
    df = spark.createDataFrame(rows, "order_id int, month date, sales double, profit double")
    got = Q.quality_detail_rows(df, ["order_id"]).groupBy("issue_type").count().collect()
    assert {r["issue_type"]: r["count"] for r in got}["negative_profit"] == 120


def test_logical_type_uses_all_values(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 100, F.lit("2024-01-05")).otherwise(F.concat(F.lit("text "), "id")).alias("t"))
    assert {r["column"]: r["logical_type"] for r in P.logical_types(df).collect()}["t"] == "text"


def test_values_are_linked_from_the_whole_dictionary(spark):
    names = [f"place_{i}" for i in range(400)] + ["new york", "北京市", "a.b"]
    known = P.known_values(spark.createDataFrame([(n,) for n in names], "city string"))
    asked = [(i, f"sales in {n}, please") for i, n in enumerate(names)] + [(900, "replace_1x"), (901, "renew yorkshire 北京市场"), (902, None)]
    got = R.link_values(spark.createDataFrame(asked, "q_id int, question string"), "q_id", "question", known, ["city"])
    found = {r["q_id"]: r["value"] for r in got.collect()}
    assert {i: found.get(i) for i in range(len(names))} == dict(enumerate(names))
    assert found[901] == "new york" and 900 not in found and 902 not in found
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_null_keys_are_one_operation(spark):
    ops = spark.createDataFrame([(1, None, "sum"), (2, None, "sum"), (3, "t", None)], "pos int, template string, agg string")
    got = A.plan_dedup(ops, ["template", "agg"], "pos").orderBy("pos").collect()
    assert [tuple(r) for r in got] == [(1, None, "sum"), (3, "t", None)]


def test_null_values_are_not_missing_keys(spark):
    base = spark.createDataFrame([(1, None), (2, "b")], "k int, v string")
    up = spark.createDataFrame([(1, "a"), (3, None)], "k int, v string")
    assert {r["k"]: r["change"] for r in O.upsert_by_key(base, up, ["k"]).collect()} == {1: "update", 2: "unchanged", 3: "insert"}
    e = spark.createDataFrame([(1, None), (2, 2.0), (3, None), (4, 1.0)], "k int, x double")
    a = spark.createDataFrame([(1, 1.0), (2, None), (3, None), (5, 1.0)], "k int, x double")
    got = {r["k"]: r["status"] for r in V.reconcile_exact(e, a, ["k"], "x").collect()}
    assert got == {1: "mismatch", 2: "mismatch", 3: "match", 4: "missing_actual", 5: "unexpected"}


def test_numbers_match_as_numbers(spark):
    rows = spark.createDataFrame([(1, 300.0, "x"), (2, 5.0000004, "y")], "id int, n double, t string")
    want = spark.createDataFrame([(1, "n", "300"), (1, "t", "x"), (2, "n", "5"), (2, "t", "y"), (3, "n", "5.1"), (4, "t", "z")], "exp_id int, column string, value string")
    assert {r["exp_id"]: r["found"] for r in V.any_row_contains(rows, "id", want).collect()} == {1: True, 2: True, 3: False, 4: False}
    texts = [("it was 1,234.5 in all", 1234.5, True), ("2e3 rows", 2000.0, True), ("100,050", 100_000.0, True), ("99,000", 100_000.0, False), (None, 1.0, False)]
    df = spark.createDataFrame(texts, "t string, e double, ok boolean")
    assert df.where(V.number_in_text(F.col("t"), F.col("e")) != F.col("ok")).count() == 0


def test_scopes_without_a_month_take_everything(spark):
    none = spark.createDataFrame([(1, None), (2, None)], "k int, month date")
    some = spark.createDataFrame([(1, None), (2, "2024-03-05")], "k int, month string").withColumn("month", F.to_date("month"))
    for scope in (S.scope_month_or_latest, S.scope_month_or_all):
        assert {r["scope_label"] for r in scope(none, "month", "2024-03").collect()} == {S.ALL_PERIODS_LABEL}
        assert scope(none, "month", None, 3).count() == 2
        assert scope(none.drop("month"), None, "2024-03").count() == 2
        assert [r["k"] for r in scope(some, "month", "2024-03").collect()] == [2]
        assert scope(some, "month", "2024-04").count() == 0


def test_period_range_is_pushed_to_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    for df in (S.period_scope(orders, "o_orderdate", "1998-12"), S.scope_month_or_all(orders, "o_orderdate", "1998-12")):
        out = contextlib_io.StringIO()
        with contextlib.redirect_stdout(out):
            df.explain("formatted")
        plan = out.getvalue()
        assert "GreaterThanOrEqual(o_orderdate,1998-12-01" in plan and "LessThan(o_orderdate,1999-01-01" in plan


def test_missing_severity_is_not_rounded(spark):
    df = spark.range(100_000).select(F.when(F.col("id") >= 19_996, 1).alias("v"))
    issue = Q.quality_issues(df).where("issue_type = 'missing'").first()
    assert issue["severity"] == "warning"


def test_long_case_names_stay_apart(spark):
    long = "c" * 90
    res = spark.createDataFrame([(long + "1", False), (long + "2", False)], "case string, passed boolean")
    log = spark.createDataFrame([], "log_id string, status string")
    assert O.eval_failure_sync(res, log, "case", "passed").select("log_id").distinct().count() == 2


def test_guarded_select(spark):
    df = spark.createDataFrame([("dataset", 1), ("x", 2)], "source string, n int")
    spark.createDataFrame([("secret",)], "tok string").createOrReplaceTempView("other_tenant")
    spark.createDataFrame([("secret",)], "tok string").createOrReplaceGlobalTempView("shared_secret")
    spark.sql("CREATE TABLE IF NOT EXISTS saved_table USING parquet AS SELECT 1 AS id")
    before = spark.conf.get("spark.sql.runSQLOnFiles", None)
    ok = {
        "SELECT count(*) AS c FROM dataset WHERE source = 'dataset'": 1,
        "with a as (select * from dataset), b as (select n from a) select sum(n) as c from b;": 3,
        "SELECT sum(d.n) AS c FROM dataset d, dataset AS e WHERE d.n = e.n": 3,
        "SELECT sum(dataset.n) AS c FROM dataset JOIN (SELECT n FROM dataset) y ON dataset.n = y.n": 3,
        "SELECT max(extract(year FROM DATE '2024-01-01')) AS c FROM dataset -- drop": 2024,
        "SELECT count(*) AS c FROM dataset WHERE source IS DISTINCT FROM 'x'": 1,
        "SELECT count(*) AS c FROM dataset WHERE n < (SELECT max(n) FROM dataset) OR source = '\"class\":\"a.PythonUDF\" reflect( other_tenant'": 1,
        "SELECT trim(LEADING 'd' FROM source) AS c FROM dataset ORDER BY n LIMIT 1": "ataset",
        "SELECT sum(y) AS c FROM dataset LATERAL VIEW explode(array(n, 10)) t AS y": 23,
    }
    for sql, want in ok.items():
        assert io.guarded_select(df, sql).first()["c"] == want, sql
    for sql in (
        "SELECT tok FROM other_tenant",
        "SELECT * FROM dataset, other_tenant",
        "SELECT * FROM dataset WHERE n IN (SELECT 1 FROM other_tenant)",
        "SELECT * FROM dataset UNION TABLE other_tenant",
        "SELECT * FROM parquet.`/tmp/x`",
        "SELECT * FROM default.dataset",
        "SELECT * FROM range(5)",
        "SELECT 1; SELECT 2",
        "DROP TABLE dataset",
        "SELECT 1) UNION ALL (SELECT tok FROM other_tenant",
        "SELECT (SELECT max(tok) FROM other_tenant) FROM dataset",
        "SELECT * FROM dataset d WHERE EXISTS (WITH dataset AS (SELECT * FROM other_tenant) SELECT 1 FROM dataset)",
        "SELECT tok FROM global_temp.shared_secret",
        "SELECT id FROM saved_table",
        "FROM dataset SELECT TRANSFORM(n) USING 'cat' AS (n)",
        "SELECT n FROM dataset WHERE n = (SELECT reflect('java.lang.Math', 'abs', 1))",
        "SELECT java_method('java.lang.Math', 'abs', n) FROM dataset",
        "SELECT missing FROM dataset",
        "INSERT INTO dataset SELECT * FROM dataset",
        "SELECT reflect('java.lang.System', 'exit', 1)",
        "",
    ):
        with pytest.raises(ValueError):
            io.guarded_select(df, sql)
    assert spark.conf.get("spark.sql.runSQLOnFiles", None) == before
    assert not [t for t in spark.catalog.listTables() + spark.catalog.listTables("global_temp") if t.name.startswith("dataset")]
    spark.sql("DROP TABLE saved_table")
    many = spark.range(700).select(F.col("id").alias("n"))
    assert io.guarded_select(many, "SELECT n FROM dataset").count() == 700


def test_all_pairs_stand_in_for_missing_health_signals(spark):
    from quarry.operators import templates as T

    df = spark.createDataFrame([(1, 2.0, 5.0), (2, 4.0, 1.0), (3, 6.0, 4.0)], "a int, b double, c double")
    got = [(r["relation"], r["r"], r["n"]) for r in T.health_signal_correlations(df).collect()]
    assert got[0] == ("a vs b", 1.0, 3) and {x[0] for x in got} == {"a vs b", "a vs c", "b vs c"}
    named = spark.createDataFrame([(1, 2.0, 5.0), (2, 4.0, 1.0), (3, 6.0, 4.0)], "nps int, csat double, z double")
    assert [r["relation"] for r in T.health_signal_correlations(named).collect()] == ["csat vs nps"]


def test_retention_cascades_to_child_tables(spark):
    log = spark.createDataFrame([(1, 1), (2, 2)], "task_id int, sequence_id int")
    tasks = spark.createDataFrame([(1, "succeeded", "2024-01-01 00:00:00"), (2, "running", "2024-01-01 00:00:00")], "task_id int, status string, updated_at string")
    kept, gone, rest = O.log_retention_cascade(log, tasks, "2024-02-01 00:00:00", 7, {"usage": log, "spans": log})
    assert [r["task_id"] for r in gone.collect()] == [1]
    assert [[r["task_id"] for r in t.collect()] for t in (kept, rest["usage"], rest["spans"])] == [[2], [2], [2]]


def test_results_come_in_order(spark):
    from quarry.operators import templates as T

    rows = [("a", 1.0, "x"), ("b", 9.0, "y"), ("c", 4.0, "x"), ("b", 1.0, None)]
    df = spark.createDataFrame(rows, "status string, sales double, pay_method string")
    got = [r["sales"] for r in T.order_status_impact(df, status="status", sales="sales").collect()]
    assert got == sorted(got, reverse=True)
