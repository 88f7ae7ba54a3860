"""Rule-level tests: limiter, p-value, question rules, masks, scopes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.operators import analysis as A
from quarry.operators import questions as R
from quarry.operators import scope as S
from quarry.sources import io
from quarry.streaming import streams as ST


def test_pvalue_known_value(spark):
    df = spark.createDataFrame([(0.5, 10), (0.0, 10), (1.0, 9), (None, 2), (0.02, 1_000_000), (-0.95, 4)], "correlation double, rows_used long")
    got = [r["p_value"] for r in A.correlation_pvalue(df).collect()]
    assert got[0] == pytest.approx(0.141113, abs=1e-6)
    assert got[1:4] == [1.0, 0.0, None]
    assert got[4] == pytest.approx(5.5e-89, rel=0.02)
    assert got[5] == pytest.approx(0.05, abs=1e-9)  # two degrees of freedom: 1 - |r|


def test_pvalue_udf(spark):
    df = spark.createDataFrame([(0.5, 10)], "correlation double, rows_used long")
    assert A.correlation_pvalue(df).first()["p_value"] == pytest.approx(0.141113, abs=1e-6)


def test_rate_limiter_two_per_minute():
    allowed, retry, accepted = ST._limit_events(np.array([0.0, 1.0, 2.0, 61.5]), [], 2, 60)
    assert allowed.tolist() == [True, True, False, True]
    assert retry[2] == max(1, int(60 - (2.0 - 0.0)) + 1)
    assert len(accepted) <= 2


def test_rate_limiter_batch_equals_stream_rule(spark):
    ev = spark.createDataFrame(
        [(i, 1 if i % 3 else 2, (pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s)).to_pydatetime()) for i, s in enumerate([0, 1, 2, 30, 61, 62, 200, 201, 202, 203])],
        "event_id long, user_id long, ts timestamp",
    )
    got = {r["event_id"]: r["allowed"] for r in ST.sliding_rate_limiter_batch(ev, "user_id", 2, 60).collect()}
    expect = {}
    for _, g in ev.select("event_id", "user_id", (F.unix_micros("ts") / 1e6).alias("t")).toPandas().groupby("user_id"):
        g = g.sort_values(["t", "event_id"])
        expect.update(zip(g["event_id"].tolist(), ST._limit_events(g["t"].to_numpy(), [], 2, 60)[0].tolist()))
    assert got == expect


def test_answerability(spark):
    qs = ["", "Delete all data now", "predict next month sales", "does discount cause churn", "weather today", "hello", "sales by region"]
    df = spark.createDataFrame([(q,) for q in qs], "q string")
    got = [r[0] for r in df.select(R.triage_answerability("q")).collect()]
    assert got == ["empty", "unsafe_or_prompt_injection", "prediction_not_supported", "causal_not_supported", "out_of_domain", "no_analysis_objective", "answerable"]


def test_goal_and_aggregation(spark):
    df = spark.createDataFrame([("当前MRR和累计MRR",), ("按城市统计销售额总和",), ("销售额和利润的相关性",), ("每个类别的订单数量",)], "q string")
    g = R.classify_goal("q")
    got = [(r[0], r[1]) for r in df.select(g, R.classify_aggregation("q", g)).collect()]
    assert got == [("mrr_snapshot_vs_cumulative", "avg"), ("group_aggregate", "sum"), ("correlation", "avg"), ("count_by_dimension", "count")]


def test_split_merges_modifier(spark):
    df = spark.createDataFrame([("当前总 Pipeline、加权 Pipeline、赢单金额是多少？按销售负责人排序。",), ("数据集有多少行？字段有哪些？利润最高的是什么",)], "q string")
    got = [r[0] for r in df.select(R.split_questions("q")).collect()]
    assert got[0] == ["当前总 Pipeline、加权 Pipeline、赢单金额是多少，按销售负责人排序"]
    assert got[1] == ["数据集有多少行，字段有哪些", "利润最高的是什么"]


def test_periods_and_month(spark):
    df = spark.createDataFrame([("2025年11月和12月的MRR变化",), ("2025-03 到 2025-06",), ("mar only",)], "q string")
    rows = df.select(R.extract_periods("q").alias("p"), R.extract_month("q").alias("m")).collect()
    assert rows[0]["p"]["periods"] == ["2025-11", "2025-12"] and rows[0]["p"]["start_period"] == "2025-11"
    assert rows[1]["p"]["periods"] == ["2025-03", "2025-06"] and rows[1]["p"]["end_period"] == "2025-06"
    assert rows[2]["m"] == 3 and rows[0]["m"] == 11


def test_filters_and_periods(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "2"), (None, "3")], "c string, n string")
    assert S.equality_filter(df, ["c='a'", "__month__=3", "junk"]).count() == 1
    assert S.equality_filter(df, ["c=__NOT_NULL__"]).count() == 2
    assert S.parse_period("2025年3月") == "2025-03-01" and S.parse_period("2025/12") == "2025-12-01"


def test_sql_guard(spark):
    df = spark.range(5)
    assert io.guarded_select(df, "SELECT count(*) AS n FROM dataset").first()["n"] == 5
    for bad in ["DROP TABLE x", "SELECT 1; SELECT 2", "SELECT * FROM parquet.`/etc`", "SELECT reflect('java.lang.System', 'exit', '0')", "select * from read_csv('x')"]:
        with pytest.raises(ValueError):
            io.guarded_select(df, bad)


def test_header_normalise_rejects(spark):
    with pytest.raises(ValueError):
        io.normalise_headers(spark.createDataFrame([(1, 2)], "a int, `A ` int"))


def test_limiter_stream_equals_batch(spark):
    import __spark_entry__ as E

    sf = "/root/testdata/sf0.001"
    stream = {(r["event_id"], r["allowed"], r["retry_after"]) for r in E.queries()["st5_sliding_rate_limiter"](spark, sf).collect()}
    batch = {(r["event_id"], r["allowed"], r["retry_after"]) for r in E.queries()["st5_rate_limiter_batch"](spark, sf).collect()}
    assert stream == batch and any(not a for _, a, _ in stream)


def test_upsert_keeps_created_at(spark):
    from quarry.operators import logs as O

    base = spark.createDataFrame([(1, "a", "2024-01-01"), (2, "b", "2024-01-02")], "k int, v string, created_at string")
    upd = spark.createDataFrame([(1, "a", "2025-01-01"), (2, "B", "2025-01-01"), (3, "c", "2025-01-01")], "k int, v string, created_at string")
    got = {r["k"]: r for r in O.upsert_by_key(base, upd, ["k"], "created_at").collect()}
    assert got[1]["change"] == "unchanged" and got[2]["change"] == "update" and got[3]["change"] == "insert"
    assert got[2]["created_at"] == "2024-01-02" and got[2]["v"] == "B" and got[3]["created_at"] == "2025-01-01"


def test_payload_rows_and_redaction(spark):
    import json

    from quarry.operators import logs as O

    payload = json.dumps({"execution_result": {"kind": "group", "source": "sql", "tables": [{"name": "t", "rows": [{"a": 1}, {"a": 2}]}]},
                          "report_markdown": "x" * 50, "dataset_preview": [{"a": 1}] * 3, "note": "ok"})
    df = spark.createDataFrame([(payload, "y" * 700)], "p string, long_text string")
    m = O.payload_metrics(df, None, "p").first()
    assert m["output_rows"] == 2 and m["output_bytes"] == len(payload.encode("utf-8"))
    r = df.select(O.redact_payload(F.col("p")).alias("r"), O.redact_payload(F.col("long_text"), 600).alias("t"), O.redact_payload(F.col("long_text")).alias("w")).first()
    red = json.loads(r["r"])
    assert red["dataset_preview"] == {"redacted": True, "row_count": 3}
    assert red["execution_result"]["tables"] == [{"name": "t", "row_count": 2}]
    assert red["report_markdown"] == {"redacted": True, "characters": 50}
    assert red["note"] == "ok" and list(red)[-1] == "note"
    assert len(r["t"]) == 600 and r["t"].endswith("...") and len(r["w"]) == 700


def test_retention_cutoff_at_least_one_day(spark):
    from quarry.operators import logs as O

    log = spark.createDataFrame([(1, 1, "succeeded", "2024-01-10 00:00:00"), (2, 2, "running", "2024-01-01 00:00:00")],
                                "task_id long, sequence_id long, status string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    tasks = O.task_table(log.withColumn("tenant_id", F.lit("t")))
    kept, expired = O.log_retention_cascade(log, tasks, "2024-01-10 12:00:00", 0)
    assert expired.count() == 0 and kept.count() == 2
    kept, expired = O.log_retention_cascade(log, tasks, "2024-01-20 00:00:00", 3)
    assert [r[0] for r in expired.collect()] == [1] and kept.count() == 1


def test_multiple_periods():
    from quarry.operators.scope import last_period, start_end_periods

    assert last_period(["2025-11", "bad", "2025-12"]) == "2025-12"
    assert start_end_periods(["2025-12", "2025-11"]) == ("2025-11-01", "2025-12-01")
    assert start_end_periods(["2025-11"]) == ("2025-11-01", None)
    assert start_end_periods(["2025-11", "2025-12"], end="2026-01") == ("2025-11-01", "2026-01-01")


def test_question_rules_meet_questions_on_both_sides(spark):
    """The registered inputs make every rule decide both ways."""
    import __spark_entry__ as E

    run = lambda name: E.queries()[name](spark, "/root/testdata/sf0.001")
    from quarry.operators import questions as R

    templates = {r["template"] for r in run("r4_classify_template").select("template").distinct().collect()}
    assert templates == {name for name, _, _ in R.TEMPLATE_RULES} | {None}
    assert {r[0] for r in run("r10_metric_notes_ask").select("metric").distinct().collect()} == {name for name, *_ in R.METRICS}
    assert run("r12_missing_role_check").select("issue").distinct().count() == 2
    assert run("r13_needs_clarification").select("needs_clarification").distinct().count() == 2
    assert 0 < run("r11_missing_value_check_region").count() < run("r11_missing_value_check").count()
    assert {r[0] is None for r in run("r5_extract_periods_ask").select("start_period").distinct().collect()} == {True, False}


def test_place_checks(spark):
    from quarry.operators import questions as R

    asks = spark.createDataFrame([(1, "上海和北京的市场"), (2, "北京"), (3, "没有"), (4, None), (5, "Xian"), (6, "xians")], "q_id long, question string")
    places = spark.createDataFrame([("北京", 1), ("上海", 0), ("xian", 2)], "value string, pos int")
    got = {r["q_id"]: (r["city"], r["issue"]) for r in R.missing_value_check(asks, "q_id", "question", places, None).collect()}
    assert got == {1: ("上海", "no_geo_column"), 2: ("北京", "no_geo_column"), 5: ("xian", "no_geo_column")}
    known = spark.createDataFrame([("城市", "上海"), ("城市", "XIAN"), ("other", "北京")], "column string, value string")
    got = R.missing_value_check(asks, "q_id", "question", places, "城市", known).collect()
    assert [(r["q_id"], r["city"], r["issue"]) for r in got] == [(2, "北京", "value_not_found")]


def test_month_texts(spark):
    from quarry.functions.columns import month_of

    texts = ["2026-1-5", "2026年1月", "2026-01-05T10:00:00", " 2026/1/31 ", "2026.01.05 23:59:59", "2026年1月5日", "202601", "20260105", "05.01.2026", "2026-13-01", "2026-1-32", "soon", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: str(r["m"]) if r["m"] else None for r in df.select("i", month_of(df, "t").alias("m")).collect()}
    assert [got[i] for i in range(len(texts))] == ["2026-01-01"] * 6 + [None] + ["2026-01-01"] * 2 + [None] * 5


def test_key_search_tests_only_what_is_open(spark):
    from quarry.operators.profile import KeySearch, grain_inference, key_candidates

    rows = [(i, i % 10, i // 10, i % 3, None if i == 4 else i, 7) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id int, user_id int, month int, date int, half_id int, void_id int")
    s = KeySearch(df, ["row_id", "user_id", "half_id"], ["month", "date"])
    assert [c for _, c in s.keys()] == [("row_id",), ("row_id", "month"), ("row_id", "date"), ("user_id", "month")]
    # pairs of a unique id, of a column with nulls, and too few dates for a user's six rows are not counted
    assert set(s.counts) == {("row_id",), ("user_id",), ("month",), ("date",), ("user_id", "month")}
    assert [r["key_columns"] for r in key_candidates(df.drop("row_id"), ["month"]).collect()] == ["user_id+month"]
    assert key_candidates(df.limit(0), ["month"]).count() == len(key_candidates(df.limit(0), ["month"]).collect())
    g = grain_inference(df.drop("row_id", "user_id")).first()
    assert (g["grain_columns"], g["duplicate_key_count"], g["notes"].split(";")[0]) == ("half_id", 0, "key_candidate")
    g = grain_inference(df.select("void_id")).first()
    assert (g["grain_columns"], g["duplicate_key_count"], g["notes"]) == ("void_id", 60, "key_candidate;duplicate_keys")
    assert grain_inference(df.select(df.date.alias("x"))).first()["notes"] == "no_stable_key"


def test_numbers_in_text_are_told_by_their_form(spark):
    """num_in equals num for every text, and casts no text that is plainly none."""
    from pyspark.sql import functions as F

    from quarry.functions.columns import num, num_in

    texts = ["1", " -2.5\t", "+.5", "5.", "1e5", "1.5E-3d", "2f", "0x1.8p1", "-0X.8P-2D", "NaN", "inf", "-Infinity", "+INF", "iNfInItY"]
    texts += ["", " ", ".", "-", "e5", "1e", "0x1", "ref-12", "1-URGENT", "4-NOT SPECIFIED", "EUR", "1,5", "1 2", "1\n", "\n1", "\x7f1", "١", "ｅ1", None]
    df = spark.createDataFrame([(t, 1.5) for t in texts], "t string, d double")
    got = df.select("t", num("t").alias("a"), num_in(df, "t").alias("b"), F.struct(num_in(df, "d")).alias("d")).collect()
    assert len(got) == len(texts) and all(r["a"] == r["b"] and r["d"][0] == 1.5 for r in got)
    assert sum(r["b"] is not None for r in got) >= 12
    plan = lambda c: df.select(num_in(df, c))._jdf.queryExecution().analyzed().toString()
    assert "RLIKE" in plan("t") and "RLIKE" not in plan("d")
