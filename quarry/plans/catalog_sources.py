"""Registered queries for S1–S11 and F1–F14 with DuckDB oracles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import month_of, num, num0, percent_normalise, text_mask
from quarry.operators import scope as S
from quarry.plans.registry import query
from quarry.plans.sqlparts import latest, mask
from quarry.session import scratch_path
from quarry.sources import io
from quarry.sources.views import Views

# ---------------------------------------------------------------- S --------
_ORDERS_AGG_SQL = "SELECT count(*) AS row_count, round(sum(o_totalprice), 2) AS total, count(DISTINCT o_orderpriority) AS priorities, min(o_orderkey) AS min_key FROM orders"


def _orders_agg(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("row_count"), F.round(F.sum("o_totalprice"), 2).alias("total"),
        F.count_distinct("o_orderpriority").alias("priorities"), F.min("o_orderkey").alias("min_key"),
    )


@query("s1_csv_scan", _ORDERS_AGG_SQL)
def s1_csv_scan(spark, sf_dir):
    """orders written as header CSV to the shared folder and read back with an
    explicit schema (no inference pass over the data)."""
    orders = Views(spark, sf_dir).orders
    path = scratch_path(spark, "csv")
    orders.write.mode("overwrite").option("header", True).csv(path)
    back = io.read_csv_dataset(spark, path, schema=orders.schema)
    return _orders_agg(back)


@query("s2_header_normalise", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s2_header_normalise(spark, sf_dir):
    """nation with padded, BOM-prefixed column names, normalised back."""
    n = Views(spark, sf_dir).nation
    padded = n.toDF("﻿ n_nationkey ", "n_name  ", "  n_regionkey")
    return io.normalise_headers(padded)


_TABLE_COLS = {
    "region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6,
    "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4,
}


@query(
    "s3_dataset_admission",
    " UNION ALL ".join(
        f"SELECT '{t}' AS dataset, 'max_rows' AS rule, CAST(250000 AS BIGINT) AS \"limit\", count(*) AS observed, count(*) <= 250000 AS passed FROM {t} "
        f"UNION ALL SELECT '{t}', 'max_columns', CAST(200 AS BIGINT), CAST({n} AS BIGINT), {n} <= 200"
        for t, n in _TABLE_COLS.items()
    ),
)
def s3_dataset_admission(spark, sf_dir):
    """Row/column cap contract for every driver table."""
    v = Views(spark, sf_dir)
    return reduce(DataFrame.unionByName, [io.dataset_admission(getattr(v, t), t, io.MAX_ROWS, io.MAX_COLUMNS) for t in _TABLE_COLS])


@query("s4_preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 20")
def s4_preview(spark, sf_dir):
    """First 20 orders by key."""
    return io.preview(Views(spark, sf_dir).orders, ["o_orderkey"], 20)


@query(
    "s5_record_normalise",
    "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, user_id, event_type, CASE WHEN isnan(value) OR isinf(value) THEN NULL ELSE value END AS value, props FROM events",
)
def s5_record_normalise(spark, sf_dir):
    """Event rows normalised for JSON output."""
    return io.to_records(Views(spark, sf_dir).events)


@query(
    "s5_record_normalise_nested",
    "SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: CASE WHEN isnan(x) OR isinf(x) THEN 0 ELSE CAST(x AS DOUBLE) END)), 4) AS total, label FROM embeddings",
)
def s5_record_normalise_nested(spark, sf_dir):
    """Array-of-float embeddings normalised element-wise (nested path)."""
    rec = io.to_records(Views(spark, sf_dir).embeddings)
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
    return rec.select("vec_id", F.size("embedding").alias("n"), F.round(total, 4).alias("total"), "label")


@query("s6_json_sink", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def s6_json_sink(spark, sf_dir):
    """Events written as JSON lines to the shared folder and read back."""
    back = io.json_sink(Views(spark, sf_dir).events, scratch_path(spark, "json"))
    return back.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("s7_result_cap", "SELECT * FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 500")
def s7_result_cap(spark, sf_dir):
    """Lines by price, the first 500 of all."""
    return io.result_cap(Views(spark, sf_dir).lineitem, [F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber"], 500)


@query(
    "s8_dataset_catalog",
    " UNION ALL ".join(
        f"SELECT '{t}' AS dataset, count(*) AS row_count, {n} AS column_count, "
        f"(SELECT string_agg(column_name, ',' ORDER BY column_index) FROM duckdb_columns() WHERE table_name = '{t}') AS columns FROM {t}"
        for t, n in _TABLE_COLS.items()
    ),
)
def s8_dataset_catalog(spark, sf_dir):
    """One row per driver table: rows, columns, column list."""
    v = Views(spark, sf_dir)
    return io.dataset_catalog({t: getattr(v, t) for t in _TABLE_COLS})


@query("s9_catalog_listing", "SELECT doc_id, source, lang, n_chars FROM documents WHERE source = 'src1' AND lang = 'en' ORDER BY doc_id DESC, doc_id LIMIT 100")
def s9_catalog_listing(spark, sf_dir):
    """documents as a catalog: one tenant/user, newest first."""
    d = Views(spark, sf_dir).documents.select("doc_id", "source", "lang", "n_chars")
    return io.catalog_listing(d, "doc_id", "doc_id", "source", "src1", "lang", "en", n=100)


@query(
    "s10_dataset_retention",
    "SELECT ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAY AS expired, count(*) AS n FROM events GROUP BY 1",
)
def s10_dataset_retention(spark, sf_dir):
    """Events older than cutoff − 7 days flagged expired."""
    r = io.dataset_retention(Views(spark, sf_dir).events, "ts", "2024-01-20 00:00:00", 7)
    return r.groupBy("expired").agg(F.count(F.lit(1)).alias("n"))


_S11 = "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 2) AS avg_price FROM dataset WHERE o_orderstatus = 'F' GROUP BY o_orderpriority ORDER BY n DESC, o_orderpriority"


@query("s11_guarded_select", _S11.replace("dataset", "orders"))
def s11_guarded_select(spark, sf_dir):
    """User SELECT over orders through the guard."""
    return io.guarded_select(Views(spark, sf_dir).orders, _S11)


# ---------------------------------------------------------------- F --------
@query("f1_equality_filter", "SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def f1_equality_filter(spark, sf_dir):
    """AND of col=value filters (quotes stripped, control keys skipped)."""
    return S.equality_filter(Views(spark, sf_dir).orders, ["o_orderstatus=F", "o_orderpriority='1-URGENT'", "__month__=3", "noise"])


@query("f2_not_null_filter", "SELECT order_id, priority FROM v_dirty WHERE priority IS NOT NULL")
def f2_not_null_filter(spark, sf_dir):
    """Rows whose priority is present (col=__NOT_NULL__)."""
    d = Views(spark, sf_dir).v_dirty.select("order_id", "priority")
    return S.equality_filter(d, ["priority=__NOT_NULL__"])


@query("f3_period_scope", "SELECT * FROM orders WHERE CAST(date_trunc('month', o_orderdate) AS DATE) = DATE '1998-03-01'")
def f3_period_scope(spark, sf_dir):
    """Orders of 1998-03 (period text '1998年3月')."""
    return S.period_scope(Views(spark, sf_dir).orders, "o_orderdate", period="1998年3月")


@query(
    "f3_period_range",
    "SELECT * FROM orders WHERE CAST(date_trunc('month', o_orderdate) AS DATE) BETWEEN DATE '1998-03-01' AND DATE '1998-06-01'",
)
def f3_period_range(spark, sf_dir):
    """Orders from 1998-03 to 1998-06 inclusive."""
    return S.period_scope(Views(spark, sf_dir).orders, "o_orderdate", start="1998-03", end="1998/6")


@query("f4_month_of_year_scope", "SELECT * FROM orders WHERE month(o_orderdate) = 3")
def f4_month_of_year_scope(spark, sf_dir):
    """March orders of every year."""
    return S.month_of_year_scope(Views(spark, sf_dir).orders, "o_orderdate", 3)


@query("f5_latest_complete_period", f"SELECT {latest('(SELECT CAST(date_trunc(\'month\', o_orderdate) AS DATE) AS month FROM orders)')} AS latest_period")
def f5_latest_complete_period(spark, sf_dir):
    """Latest month of orders with at least half the median monthly count."""
    return S.latest_period_table(Views(spark, sf_dir).orders, "o_orderdate")


@query("f5_latest_complete_period_lineitem", f"SELECT {latest('(SELECT CAST(date_trunc(\'month\', l_shipdate) AS DATE) AS month FROM lineitem)')} AS latest_period")
def f5_latest_complete_period_lineitem(spark, sf_dir):
    """Latest complete ship month of lineitem."""
    return S.latest_period_table(Views(spark, sf_dir).lineitem, "l_shipdate")


@query(
    "f6_late_outlier_periods",
    f"""WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders)
SELECT strftime(month, '%Y-%m') AS period, count(*) AS row_count FROM m WHERE month > {latest('m')} GROUP BY month""",
)
def f6_late_outlier_periods(spark, sf_dir):
    """Months after the latest complete month, with row counts."""
    return S.late_outlier_periods(Views(spark, sf_dir).orders, "o_orderdate")


@query("f7_scope_month_or_latest", f"SELECT row_key, month, strftime(month, '%Y-%m') AS scope_label FROM v_subs WHERE month = {latest('v_subs')}")
def f7_scope_month_or_latest(spark, sf_dir):
    """v_subs rows of the latest complete month, labelled."""
    return S.scope_month_or_latest(Views(spark, sf_dir).v_subs.select("row_key", "month"), "month").drop("_period")


@query("f8_scope_month_or_all", "SELECT row_key, month, '3 月' AS scope_label FROM v_subs WHERE month(month) = 3")
def f8_scope_month_or_all(spark, sf_dir):
    """v_subs rows of month-of-year 3 (default would be all rows)."""
    return S.scope_month_or_all(Views(spark, sf_dir).v_subs.select("row_key", "month"), "month", month=3).drop("_period")


@query(
    "f9_month_bucket",
    "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders",
)
def f9_month_bucket(spark, sf_dir):
    """Order dates rendered as text in seven formats, parsed back to months."""
    o = Views(spark, sf_dir).orders
    formats = ["yyyy-MM-dd", "yyyy/MM/dd", "yyyy-MM-dd HH:mm:ss", "yyyy-M-d", "yyyy年M月", "yyyy-MM-dd'T'HH:mm:ss", "yyyy年M月d日"]
    text = F.coalesce(*[F.when(F.col("o_orderkey") % len(formats) == i, F.date_format("o_orderdate", f)) for i, f in enumerate(formats)])
    t = o.select("o_orderkey", text.alias("d"))
    return t.select("o_orderkey", month_of(t, "d").alias("month"))


@query(
    "f10_text_masks",
    "SELECT "
    + ", ".join(
        f"count_if({mask(c, k)}) AS {k}_{c}"
        for c, k in [("renewal_risk", "high_risk"), ("renewal_risk", "medium_high"), ("payment_status", "payment_issue"), ("churn", "yes")]
    )
    + " FROM v_subs",
)
def f10_text_masks(spark, sf_dir):
    """Counts of the risk, payment-issue and churn masks on v_subs."""
    v = Views(spark, sf_dir).v_subs
    pairs = [("renewal_risk", "high_risk"), ("renewal_risk", "medium_high"), ("payment_status", "payment_issue"), ("churn", "yes")]
    return v.agg(*[F.count_if(text_mask(c, k)).alias(f"{k}_{c}") for c, k in pairs])


@query(
    "f10_text_masks_sales",
    "SELECT "
    + ", ".join(f"count_if({mask('status', k)}) AS {k}" for k in ["completed", "cancelled", "returned"])
    + f", (SELECT count_if({mask('stage', 'won')}) FROM v_pipe) AS won FROM v_sales",
)
def f10_text_masks_sales(spark, sf_dir):
    """Counts of the order-status masks on v_sales and the won mask on v_pipe."""
    v = Views(spark, sf_dir)
    won = v.v_pipe.agg(F.count_if(text_mask("stage", "won")).alias("won"))
    return v.v_sales.agg(*[F.count_if(text_mask("status", k)).alias(k) for k in ["completed", "cancelled", "returned"]]).crossJoin(won)


@query(
    "f11_numeric_coerce",
    """SELECT count(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS parsed, sum(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS total_drop,
 sum(coalesce(TRY_CAST(props AS DOUBLE), 0)) AS total_zero, count(TRY_CAST(props AS DOUBLE)) AS whole_text_parsed FROM events""",
)
def f11_numeric_coerce(spark, sf_dir):
    """Text → number: the JSON field parses, the whole JSON text does not."""
    e = Views(spark, sf_dir).events
    k = F.get_json_object("props", "$.k")
    return e.agg(F.count(num(k)).alias("parsed"), F.sum(num(k)).alias("total_drop"), F.sum(num0("props")).alias("total_zero"), F.count(num("props")).alias("whole_text_parsed"))


@query(
    "f12_percent_normalise",
    "SELECT round(sum(CASE WHEN win_rate <= 1 THEN win_rate ELSE win_rate / 100 END), 4) AS total, count_if(win_rate > 1) AS scaled FROM v_pipe",
)
def f12_percent_normalise(spark, sf_dir):
    """Win rates above 1 read as percentages."""
    p = Views(spark, sf_dir).v_pipe
    return p.agg(F.round(F.sum(percent_normalise(F.col("win_rate"))), 4).alias("total"), F.count_if(F.col("win_rate") > 1).alias("scaled"))


@query(
    "f13_empty_filter_report",
    "SELECT CASE WHEN count(*) = 0 THEN 'unanswerable' ELSE 'answerable' END AS status, count(*) AS matched_rows, 'o_totalprice' AS requested_metrics, "
    "'o_orderpriority' AS requested_dimensions, 'o_orderstatus=X' AS requested_filters FROM orders WHERE o_orderstatus = 'X'",
)
def f13_empty_filter_report(spark, sf_dir):
    """An impossible filter yields an 'unanswerable' row, not an empty answer."""
    return S.empty_filter_report(Views(spark, sf_dir).orders, ["o_orderstatus=X"], ["o_totalprice"], ["o_orderpriority"])


@query(
    "f14_tenant_scope",
    "SELECT doc_id, source, lang FROM documents WHERE (source = 'src1' AND lang = 'en') OR (source = 'system' AND lang = 'system')",
)
def f14_tenant_scope(spark, sf_dir):
    """documents of one (source, lang) tenant/user plus shared rows."""
    d = Views(spark, sf_dir).documents.select("doc_id", "source", "lang")
    return S.tenant_scope(d, "source", "lang", "src1", "en")
