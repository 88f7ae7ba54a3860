"""Registered queries for P1–P14 with DuckDB oracles."""

from __future__ import annotations

from quarry.operators import profile as P
from quarry.plans.catalog_analysis import rnd
from quarry.plans.registry import query
from quarry.sources.views import Views

# (name, Spark dtype) of the tables profiled below, as Spark reads them.
DIRTY_COLS = [
    ("order_id", "bigint"), ("customer_id", "bigint"), ("month", "date"), ("priority", "string"), ("mrr", "double"),
    ("quantity", "double"), ("unit_price", "double"), ("discount_rate", "double"), ("currency", "string"), ("reference", "string"),
    ("sales", "double"), ("cost", "double"), ("profit", "double"), ("profit_rate", "double"),
]
ORDERS_COLS = [
    ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
    ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string"),
]
CUSTOMER_COLS = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string")]
DOC_COLS = [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")]


def _stats_sql(table: str, cols: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS column, '{t}' AS dtype, count_if({c} IS NULL) AS missing_count, "
        f"round(coalesce(count_if({c} IS NULL) / nullif(count(*), 0), 0), 4) AS missing_rate, count(DISTINCT {c}) AS unique_count, count(*) AS row_count FROM {table}"
        for i, (c, t) in enumerate(cols)
    )


@query("p1_column_stats", _stats_sql("v_dirty", DIRTY_COLS))
def p1_column_stats(spark, sf_dir):
    """Missing and distinct counts of every v_dirty column in one pass."""
    return P.column_stats(Views(spark, sf_dir).v_dirty)


@query("p1_column_stats_orders", _stats_sql("orders", ORDERS_COLS))
def p1_column_stats_orders(spark, sf_dir):
    """Missing and distinct counts of every orders column."""
    return P.column_stats(Views(spark, sf_dir).orders)


def _kind(t: str) -> str:
    return {"bigint": "numeric", "int": "numeric", "double": "numeric", "date": "datetime", "timestamp_ntz": "datetime", "boolean": "boolean"}.get(t, "string")


def _types_sql(table: str, cols: list[tuple[str, str]], key: str) -> str:
    parts = []
    for i, (c, t) in enumerate(cols):
        k = _kind(t)
        if k != "string":
            parts.append(f"SELECT {i} AS position, '{c}' AS column, '{t}' AS dtype, '{k}' AS logical_type")
            continue
        parts.append(
            f"""SELECT {i}, '{c}', '{t}', (WITH f AS (SELECT {c} AS v FROM {table} WHERE {c} IS NOT NULL),
 s AS (SELECT count({c}) AS nn, count(DISTINCT {c}) AS u FROM {table})
 SELECT CASE WHEN nn = 0 THEN 'unknown' WHEN (SELECT avg(CASE WHEN TRY_CAST(trim(v) AS TIMESTAMP) IS NOT NULL THEN 1.0 ELSE 0.0 END) FROM f) >= 0.8 THEN 'datetime'
 WHEN u / greatest(1, nn) <= 0.5 OR u <= 30 THEN 'categorical' ELSE 'text' END FROM s)"""
        )
    return " UNION ALL ".join(parts)


@query("p2_logical_type", _types_sql("v_dirty", DIRTY_COLS, "order_id"))
def p2_logical_type(spark, sf_dir):
    """Six-way logical type of each v_dirty column."""
    return P.logical_types(Views(spark, sf_dir).v_dirty, ["order_id"])


@query("p2_logical_type_documents", _types_sql("documents", DOC_COLS, "doc_id"))
def p2_logical_type_documents(spark, sf_dir):
    """Logical types of the documents table."""
    return P.logical_types(Views(spark, sf_dir).documents, ["doc_id"])


@query(
    "p3_sample_values",
    "SELECT \"column\", CAST(pos AS INTEGER) AS pos, value FROM (SELECT \"column\", value, row_number() OVER (PARTITION BY \"column\" ORDER BY c_custkey) AS pos FROM ("
    + " UNION ALL ".join(f"SELECT c_custkey, '{c}' AS column, CAST({c} AS VARCHAR) AS value FROM customer WHERE {c} IS NOT NULL" for c, _ in CUSTOMER_COLS)
    + ")) WHERE pos <= 5",
)
def p3_sample_values(spark, sf_dir):
    """First five non-null values of each customer column."""
    return P.sample_values(Views(spark, sf_dir).customer, ["c_custkey"])


_LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "p4_numeric_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
 round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS q1, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS q3,
 (SELECT count_if({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) FROM lineitem, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM lineitem)) AS outlier_count
 FROM lineitem"""
        for c in _LI_NUM
    ),
)
def p4_numeric_profile(spark, sf_dir):
    """min/max/mean/std/quartiles/outliers of every numeric lineitem column."""
    return rnd(P.numeric_profile(Views(spark, sf_dir).lineitem), ["mean", "std", "q1", "q3"], 4)


@query(
    "p5_datetime_profile",
    "SELECT 'o_orderdate' AS column, CAST(min(o_orderdate) AS TIMESTAMP) AS min, CAST(max(o_orderdate) AS TIMESTAMP) AS max FROM orders",
)
def p5_datetime_profile(spark, sf_dir):
    """Date range of the order date."""
    return P.datetime_profile(Views(spark, sf_dir).orders, ["o_orderdate"])


@query(
    "p5_datetime_profile_events",
    "SELECT 'ts' AS column, CAST(min(ts) AS TIMESTAMP) AS min, CAST(max(ts) AS TIMESTAMP) AS max FROM events",
)
def p5_datetime_profile_events(spark, sf_dir):
    """Time range of the event log."""
    return P.datetime_profile(Views(spark, sf_dir).events, ["ts"])


def _top_sql(table: str, cols: list[str]) -> str:
    return (
        "SELECT \"column\", CAST(rank AS INTEGER) AS rank, value, count FROM (SELECT \"column\", value, count, row_number() OVER (PARTITION BY \"column\" ORDER BY count DESC, value) AS rank FROM ("
        + " UNION ALL ".join(f"SELECT '{c}' AS column, CAST({c} AS VARCHAR) AS value, count(*) AS count FROM {table} WHERE {c} IS NOT NULL GROUP BY 2" for c in cols)
        + ")) WHERE rank <= 5"
    )


@query("p6_top_values", _top_sql("customer", ["c_name", "c_nationkey", "c_mktsegment"]))
def p6_top_values(spark, sf_dir):
    """Top five values of customer text/category columns."""
    return P.top_values(Views(spark, sf_dir).customer, ["c_name", "c_nationkey", "c_mktsegment"])


@query("p6_top_values_orders", _top_sql("orders", ["o_orderstatus", "o_orderpriority"]))
def p6_top_values_orders(spark, sf_dir):
    """Top five values of order status and priority."""
    return P.top_values(Views(spark, sf_dir).orders, ["o_orderstatus", "o_orderpriority"])


@query(
    "p7_type_groups",
    "SELECT 'numeric' AS \"group\", 'o_orderkey,o_custkey,o_totalprice' AS columns UNION ALL SELECT 'datetime', 'o_orderdate' "
    "UNION ALL SELECT 'categorical', 'o_orderstatus,o_orderpriority'",
)
def p7_type_groups(spark, sf_dir):
    """Column lists per logical type of orders."""
    return P.type_groups(P.logical_types(Views(spark, sf_dir).orders, ["o_orderkey"]))


def _cand_sql(table: str, cands: list[list[str]]) -> str:
    parts = []
    for j, cols in enumerate(cands):
        nn = " AND ".join(f"{c} IS NOT NULL" for c in cols)
        parts.append(
            f"SELECT {j} AS position, '{'+'.join(cols)}' AS key_columns FROM {table} HAVING count_if(NOT ({nn})) = 0 AND count(DISTINCT ({', '.join(cols)})) = count(*)"
        )
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") ORDER BY position"


@query("p8_key_candidates", _cand_sql("events", [["event_id"], ["user_id"], ["event_id", "ts"], ["user_id", "ts"]]))
def p8_key_candidates(spark, sf_dir):
    """Unique, non-null id columns and id×time pairs of the event log."""
    return P.key_candidates(Views(spark, sf_dir).events)


@query("p8_key_candidates_dirty", _cand_sql("v_dirty", [["order_id"], ["customer_id"], ["order_id", "month"], ["customer_id", "month"]]))
def p8_key_candidates_dirty(spark, sf_dir):
    """Key candidates of v_dirty (copies make order_id non-unique)."""
    return P.key_candidates(Views(spark, sf_dir).v_dirty)


_CLEAN = "(SELECT DISTINCT * FROM v_dirty)"


@query("p8_key_candidates_clean", _cand_sql(_CLEAN, [["order_id"], ["customer_id"], ["order_id", "month"], ["customer_id", "month"]]))
def p8_key_candidates_clean(spark, sf_dir):
    """Key candidates of v_dirty without its copies: order_id, alone and with the month."""
    return P.key_candidates(Views(spark, sf_dir).v_dirty.distinct())


@query(
    "p9_duplicate_key_count",
    "SELECT CAST(coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS BIGINT) AS duplicate_key_count FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)",
)
def p9_duplicate_key_count(spark, sf_dir):
    """Lines sharing (orderkey, linenumber) with another line."""
    return P.duplicate_key_count(Views(spark, sf_dir).lineitem, ["l_orderkey", "l_linenumber"])


@query("p10_time_range", "SELECT CAST(min(l_shipdate) AS TIMESTAMP) AS time_min, CAST(max(l_shipdate) AS TIMESTAMP) AS time_max FROM lineitem")
def p10_time_range(spark, sf_dir):
    """Ship-date range of lineitem."""
    return P.time_range(Views(spark, sf_dir).lineitem, "l_shipdate")


def _cands_list(table: str, cands: list[list[str]]) -> str:
    return f"(SELECT coalesce(string_agg(key_columns, ';' ORDER BY position), '') FROM ({_cand_sql(table, cands)}))"


@query(
    "p11_grain_inference",
    f"""SELECT 'customer_time_snapshot' AS grain_type, 'customer_id+month' AS grain_columns,
 {_cands_list('v_subs', [['customer_id'], ['customer_id', 'month']])} AS primary_key_candidates, 'month' AS time_field,
 (SELECT CAST(min(month) AS TIMESTAMP) FROM v_subs) AS time_min, (SELECT CAST(max(month) AS TIMESTAMP) FROM v_subs) AS time_max,
 (SELECT CAST(coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM v_subs GROUP BY customer_id, month)) AS duplicate_key_count,
 'customer_time_not_unique_customer;duplicate_keys;time_range' AS notes""",
)
def p11_grain_inference(spark, sf_dir):
    """Grain of v_subs: a customer-month snapshot with duplicate keys."""
    return P.grain_inference(Views(spark, sf_dir).v_subs)


@query(
    "p11_grain_inference_events",
    f"""SELECT 'detail' AS grain_type, 'event_id' AS grain_columns,
 {_cands_list('events', [['event_id'], ['user_id'], ['event_id', 'ts'], ['user_id', 'ts']])} AS primary_key_candidates, 'ts' AS time_field,
 CAST(min(ts) AS TIMESTAMP) AS time_min, CAST(max(ts) AS TIMESTAMP) AS time_max,
 (SELECT CAST(coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM events GROUP BY event_id)) AS duplicate_key_count, 'key_candidate;time_range' AS notes FROM events""",
)
def p11_grain_inference_events(spark, sf_dir):
    """Grain of the event log: detail rows keyed by event_id."""
    return P.grain_inference(Views(spark, sf_dir).events)


@query(
    "p12_known_values",
    "SELECT \"column\", lower(value) AS value_key, min(value) AS value FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS column, trim(CAST({c} AS VARCHAR)) AS value FROM customer WHERE {c} IS NOT NULL" for c in ["c_name", "c_mktsegment"])
    + ") WHERE length(value) > 0 GROUP BY \"column\", lower(value)",
)
def p12_known_values(spark, sf_dir):
    """All distinct values of customer name and segment."""
    return P.known_values(Views(spark, sf_dir).customer, ["c_name", "c_mktsegment"])


@query(
    "p13_high_missing_review",
    "SELECT \"column\", missing_rate FROM (" + _stats_sql("v_dirty", DIRTY_COLS) + ") WHERE missing_rate >= 0.2",
)
def p13_high_missing_review(spark, sf_dir):
    """v_dirty columns with at least 20 % missing values."""
    return P.high_missing_review(P.column_stats(Views(spark, sf_dir).v_dirty))


@query(
    "p14_scope_review",
    """SELECT q_id, question, 'mrr_snapshot' AS review_note FROM v_q UNION ALL SELECT q_id, question, 'order_status_scope' FROM v_q
 WHERE (contains(lower(question), '销售额') OR contains(lower(question), '利润') OR contains(lower(question), 'sales') OR contains(lower(question), 'profit') OR contains(lower(question), '订单'))
 AND NOT contains(question, '已完成')""",
)
def p14_scope_review(spark, sf_dir):
    """Review notes for logged questions against the v_sales + v_subs columns."""
    v = Views(spark, sf_dir)
    return P.scope_review(v.v_q, "question", v.v_sales.columns + v.v_subs.columns)
