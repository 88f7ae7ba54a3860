"""Registered queries for A1–A23 with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import analysis as A
from quarry.plans.registry import query
from quarry.plans.sqlparts import latest, mask
from quarry.sources.views import Views


def rnd(df: DataFrame, cols: list[str], digits: int = 2) -> DataFrame:
    return df.select(*[F.round(F.col(c), digits).alias(c) if c in cols else F.col(c) for c in df.columns])


# ---------------------------------------------------------------- A1 -------
@query(
    "a1_group_sum",
    "SELECT o_orderpriority AS dimension, round(sum(o_totalprice), 2) AS sum_o_totalprice FROM orders WHERE o_orderpriority IS NOT NULL "
    "GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1",
)
def a1_group_sum(spark, sf_dir):
    """Sum of order value per priority."""
    return rnd(A.group_aggregate(Views(spark, sf_dir).orders, "o_orderpriority", "o_totalprice", "sum"), ["sum_o_totalprice"])


@query(
    "a1_group_avg",
    "SELECT category AS dimension, round(avg(sales), 4) AS avg_sales FROM v_sales WHERE category IS NOT NULL AND city = 'NATION_1' "
    "GROUP BY 1 ORDER BY avg(sales) DESC, 1",
)
def a1_group_avg(spark, sf_dir):
    """Average line sales per brand, filtered to one city."""
    return rnd(A.group_aggregate(Views(spark, sf_dir).v_sales, "category", "sales", "avg", ["city=NATION_1"]), ["avg_sales"], 4)


@query(
    "a1_group_count",
    "SELECT l_returnflag AS dimension, count(*) AS row_count FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1",
)
def a1_group_count(spark, sf_dir):
    """Line count per return flag."""
    return A.group_aggregate(Views(spark, sf_dir).lineitem, "l_returnflag", "*", "count")


@query(
    "a1_group_min",
    "SELECT c_mktsegment AS dimension, min(c_acctbal) AS min_c_acctbal FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY 2 ASC, 1",
)
def a1_group_min(spark, sf_dir):
    """Smallest balance per segment (ascending order)."""
    return A.group_aggregate(Views(spark, sf_dir).customer, "c_mktsegment", "c_acctbal", "min", desc=False)


@query(
    "a1_group_max",
    "SELECT p_brand AS dimension, max(p_retailprice) AS max_p_retailprice FROM part WHERE p_brand IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1",
)
def a1_group_max(spark, sf_dir):
    """Largest retail price per brand, top 20."""
    return A.group_aggregate(Views(spark, sf_dir).part, "p_brand", "p_retailprice", "max")


@query(
    "a1_group_median",
    "SELECT o_orderpriority AS dimension, round(median(o_totalprice), 4) AS median_o_totalprice FROM orders WHERE o_orderpriority IS NOT NULL "
    "GROUP BY 1 ORDER BY median(o_totalprice) DESC, 1",
)
def a1_group_median(spark, sf_dir):
    """Exact median order value per priority (sort-based quantile)."""
    return rnd(A.group_aggregate(Views(spark, sf_dir).orders, "o_orderpriority", "o_totalprice", "median"), ["median_o_totalprice"], 4)


@query(
    "a2_count_by_dimension",
    "SELECT event_type AS dimension, count(*) AS row_count FROM events WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1",
)
def a2_count_by_dimension(spark, sf_dir):
    """Events per type."""
    return A.count_by_dimension(Views(spark, sf_dir).events, "event_type")


def _trend_sql(agg: str, fn: str, digits: int) -> str:
    return (
        f"SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, round({fn}(o_totalprice), {digits}) AS {agg}_o_totalprice FROM orders "
        "WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY 1 ORDER BY 1"
    )


@query("a3_time_trend_sum", _trend_sql("sum", "sum", 2))
def a3_time_trend_sum(spark, sf_dir):
    """Monthly order value."""
    return rnd(A.time_trend(Views(spark, sf_dir).orders, "o_orderdate", "o_totalprice", "sum"), ["sum_o_totalprice"])


@query("a3_time_trend_avg", _trend_sql("avg", "avg", 4))
def a3_time_trend_avg(spark, sf_dir):
    """Monthly average order value."""
    return rnd(A.time_trend(Views(spark, sf_dir).orders, "o_orderdate", "o_totalprice", "avg"), ["avg_o_totalprice"], 4)


@query("a3_time_trend_median", _trend_sql("median", "median", 4))
def a3_time_trend_median(spark, sf_dir):
    """Monthly median order value (exact)."""
    return rnd(A.time_trend(Views(spark, sf_dir).orders, "o_orderdate", "o_totalprice", "median"), ["median_o_totalprice"], 4)


@query(
    "a4_top_records",
    "SELECT p_name, p_brand, p_retailprice FROM part WHERE p_name IS NOT NULL AND p_brand IS NOT NULL AND p_retailprice IS NOT NULL "
    "ORDER BY p_retailprice DESC, p_name, p_brand LIMIT 20",
)
def a4_top_records(spark, sf_dir):
    """Top 20 parts by retail price."""
    return A.top_records(Views(spark, sf_dir).part, ["p_name", "p_brand"], "p_retailprice")


@query(
    "a4_top_records_asc",
    "SELECT c_name, c_acctbal FROM customer WHERE c_name IS NOT NULL AND c_acctbal IS NOT NULL AND c_mktsegment = 'BUILDING' ORDER BY c_acctbal ASC, c_name LIMIT 20",
)
def a4_top_records_asc(spark, sf_dir):
    """Lowest 20 balances in one segment (aggregation=min → ascending)."""
    return A.top_records(Views(spark, sf_dir).customer, ["c_name"], "c_acctbal", ["c_mktsegment=BUILDING"], descending=False)


@query(
    "a5_market_recommendation",
    """SELECT category AS dimension, count(*) AS order_count, round(sum(sales), 2) AS total_sales, round(avg(sales), 4) AS avg_sales,
 round(sum(profit), 2) AS total_profit, round(avg(profit), 4) AS avg_profit, round(sum(quantity), 2) AS total_quantity,
 round(coalesce(sum(profit), 0) + count(*) * 10 + coalesce(sum(sales), 0) * 0.1 + coalesce(sum(quantity), 0) * 5, 2) AS recommendation_score
FROM v_sales WHERE category IS NOT NULL AND city = 'NATION_3' GROUP BY category
ORDER BY sum(profit) DESC, sum(sales) DESC, sum(quantity) DESC, count(*) DESC, category LIMIT 10""",
)
def a5_market_recommendation(spark, sf_dir):
    """Category recommendation in one city."""
    out = A.market_recommendation(Views(spark, sf_dir).v_sales, "category", ["sales", "profit", "quantity"], ["city=NATION_3"])
    return rnd(rnd(out, ["total_sales", "total_profit", "total_quantity", "recommendation_score"]), ["avg_sales", "avg_profit"], 4)


def _overview_sql(table: str, date_col: str, cols: str, n: int) -> str:
    return (
        f"SELECT count(*) AS row_count, min(TRY_CAST({date_col} AS TIMESTAMP)) AS min_date, max(TRY_CAST({date_col} AS TIMESTAMP)) AS max_date, "
        f"{n} AS column_count, '{cols}' AS columns FROM {table}"
    )


@query("a6_dataset_overview", _overview_sql("orders", "o_orderdate", "o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority", 6))
def a6_dataset_overview(spark, sf_dir):
    """Row count, date range and column list of orders."""
    return A.dataset_overview(Views(spark, sf_dir).orders, "o_orderdate")


@query(
    "a6_dataset_overview_lineitem",
    _overview_sql(
        "lineitem",
        "l_shipdate",
        "l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate",
        11,
    ),
)
def a6_dataset_overview_lineitem(spark, sf_dir):
    """Row count, ship-date range and column list of lineitem."""
    return A.dataset_overview(Views(spark, sf_dir).lineitem, "l_shipdate")


@query(
    "a7_describe_sql",
    "SELECT count(o_totalprice) AS non_null_count, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS min, max(o_totalprice) AS max, "
    "round(stddev_samp(o_totalprice), 4) AS std FROM orders",
)
def a7_describe_sql(spark, sf_dir):
    """Count, mean, min, max, std of order value."""
    return rnd(A.describe_metric(Views(spark, sf_dir).orders, "o_totalprice"), ["mean", "std"], 4)


_LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _describe_sql(table: str, cols: list[str]) -> str:
    parts = [
        f"SELECT '{c}' AS column, count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, "
        f"round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS p25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS p50, "
        f"round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM {table}"
        for c in cols
    ]
    return " UNION ALL ".join(parts)


@query("a8_describe", _describe_sql("lineitem", _LI_NUM))
def a8_describe(spark, sf_dir):
    """count/mean/std/min/quartiles/max of every numeric lineitem column."""
    return rnd(A.describe(Views(spark, sf_dir).lineitem), ["mean", "std", "p25", "p50", "p75"], 4)


@query(
    "a9_correlation",
    "SELECT CASE WHEN count(*) >= 3 THEN round(covar_samp(l_quantity, l_extendedprice) / nullif(stddev_samp(l_quantity) * stddev_samp(l_extendedprice), 0), 6) END AS correlation, "
    "count(*) AS rows_used FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL",
)
def a9_correlation(spark, sf_dir):
    """Pearson r of quantity and extended price."""
    return rnd(A.correlation(Views(spark, sf_dir).lineitem, "l_quantity", "l_extendedprice"), ["correlation"], 6)


@query(
    "a9_correlation_by_category",
    "SELECT category, CASE WHEN count(*) >= 3 THEN round(covar_samp(quantity, sales) / nullif(stddev_samp(quantity) * stddev_samp(sales), 0), 6) END AS correlation, "
    "count(*) AS rows_used FROM v_sales WHERE quantity IS NOT NULL AND sales IS NOT NULL GROUP BY category",
)
def a9_correlation_by_category(spark, sf_dir):
    """Grouped Pearson r per brand."""
    return rnd(A.correlation(Views(spark, sf_dir).v_sales, "quantity", "sales", by=["category"]), ["correlation"], 6)


@query(
    "a10_correlation_pvalue",
    """WITH g AS (SELECT category, corr(quantity, discount_rate) AS r, count(*) AS n FROM v_sales WHERE quantity IS NOT NULL AND discount_rate IS NOT NULL GROUP BY category),
t AS (SELECT *, n - 2.0 AS dof, abs(r) * sqrt((n - 2) / (1 - r * r)) AS x FROM g),
-- two-sided tail of Student's density: 1 - 2 * integral from 0 to x, by the midpoint rule
i AS (SELECT *, list_sum(list_transform(range(20000), lambda k: exp(lgamma((dof + 1) / 2) - lgamma(dof / 2)) / sqrt(pi() * dof) * pow(1 + pow((k + 0.5) * x / 20000, 2) / dof, -(dof + 1) / 2))) * x / 20000 AS half FROM t)
SELECT category, n AS rows_used, round(r, 6) AS correlation, round(1 - 2 * half, 6) AS p_value FROM i""",
)
def a10_correlation_pvalue(spark, sf_dir):
    """Per-brand r with its two-sided p-value."""
    corr = A.correlation(Views(spark, sf_dir).v_sales, "quantity", "discount_rate", by=["category"])
    return rnd(A.correlation_pvalue(corr), ["correlation", "p_value"], 6)


@query(
    "a11_correlation_sample",
    "SELECT l_quantity, l_extendedprice FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL "
    "ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice LIMIT 200",
)
def a11_correlation_sample(spark, sf_dir):
    """First 200 complete (quantity, price) pairs by line key."""
    return A.correlation_sample(Views(spark, sf_dir).lineitem, "l_quantity", "l_extendedprice", ["l_orderkey", "l_linenumber"])


@query(
    "a12_histogram",
    """WITH v AS (SELECT o_totalprice AS x FROM orders WHERE o_totalprice IS NOT NULL),
s AS (SELECT least(12, greatest(4, CAST(floor(sqrt(count(*))) AS INTEGER))) AS bins,
 CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo, CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM v HAVING count(*) > 0),
b AS (SELECT least(CAST(floor((x - lo) / (hi - lo) * bins) AS INTEGER), bins - 1) AS bin FROM v, s),
c AS (SELECT bin, count(*) AS cnt FROM b GROUP BY bin),
e AS (SELECT CAST(unnest(range(0, bins)) AS INTEGER) AS bin, lo, hi, bins FROM s)
SELECT e.bin, round(lo + e.bin * (hi - lo) / bins, 4) AS bin_start, round(lo + (e.bin + 1) * (hi - lo) / bins, 4) AS bin_end, coalesce(cnt, 0) AS count
FROM e LEFT JOIN c ON e.bin = c.bin""",
)
def a12_histogram(spark, sf_dir):
    """Equal-width histogram of order value with empty bins."""
    return rnd(A.histogram(Views(spark, sf_dir).orders, "o_totalprice"), ["bin_start", "bin_end"], 4)


@query("a13_distribution_stats", _describe_sql("events", ["value"]))
def a13_distribution_stats(spark, sf_dir):
    """Distribution statistics of the event value."""
    return rnd(A.distribution_stats(Views(spark, sf_dir).events, "value"), ["mean", "std", "p25", "p50", "p75"], 4)


def _bounds_sql(table: str, col: str) -> str:
    return f"""WITH q AS (SELECT quantile_cont({col}, 0.25) AS q1, quantile_cont({col}, 0.75) AS q3 FROM {table} WHERE {col} IS NOT NULL),
b AS (SELECT q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound FROM q)
SELECT round(q1, 4) AS q1, round(q3, 4) AS q3, round(iqr, 4) AS iqr, round(lower_bound, 4) AS lower_bound, round(upper_bound, 4) AS upper_bound,
 (SELECT count(*) FROM {table}, b WHERE {col} < lower_bound OR {col} > upper_bound) AS outlier_count FROM b"""


_BOUND_COLS = ["q1", "q3", "iqr", "lower_bound", "upper_bound"]


@query("a14_outlier_bounds", _bounds_sql("orders", "o_totalprice"))
def a14_outlier_bounds(spark, sf_dir):
    """IQR bounds and outlier count of order value."""
    return rnd(A.outlier_bounds(Views(spark, sf_dir).orders, "o_totalprice"), _BOUND_COLS, 4)


@query("a14_outlier_bounds_lineitem", _bounds_sql("lineitem", "l_extendedprice"))
def a14_outlier_bounds_lineitem(spark, sf_dir):
    """IQR bounds and outlier count of line extended price."""
    return rnd(A.outlier_bounds(Views(spark, sf_dir).lineitem, "l_extendedprice"), _BOUND_COLS, 4)


@query(
    "a15_outlier_rows",
    """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem)
SELECT lineitem.* FROM lineitem, q WHERE l_extendedprice < q1 - 1.5 * (q3 - q1) OR l_extendedprice > q3 + 1.5 * (q3 - q1)
ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_partkey LIMIT 100""",
)
def a15_outlier_rows(spark, sf_dir):
    """First 100 outlier lines by extended price."""
    return A.outlier_rows(Views(spark, sf_dir).lineitem, "l_extendedprice", ["l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey"])


# ---------------------------------------------------------------- A16-A19 --
_MRR_V = f"""v AS (SELECT * FROM v_subs WHERE mrr IS NOT NULL AND month IS NOT NULL),
lp AS (SELECT {latest('v')} AS lp),
k AS (SELECT * FROM v WHERE month <= (SELECT lp FROM lp))"""


@query(
    "a16_mrr_scope_comparison",
    f"""WITH {_MRR_V}
SELECT 'current' AS scope, strftime((SELECT lp FROM lp), '%Y-%m') AS month_range, count(*) AS records, count(DISTINCT customer_id) AS customers, round(coalesce(sum(mrr), 0), 2) AS mrr
FROM k WHERE month = (SELECT lp FROM lp)
UNION ALL SELECT 'cumulative', strftime(min(month), '%Y-%m') || ' to ' || strftime((SELECT lp FROM lp), '%Y-%m'), count(*), count(DISTINCT customer_id), round(coalesce(sum(mrr), 0), 2) FROM k""",
)
def a16_mrr_scope_comparison(spark, sf_dir):
    """Current vs cumulative MRR."""
    return A.mrr_scope_comparison(Views(spark, sf_dir).v_subs)


@query(
    "a17_monthly_mrr",
    f"WITH {_MRR_V} SELECT strftime(month, '%Y-%m') AS month, round(sum(mrr), 2) AS mrr, count(*) AS records, count(DISTINCT customer_id) AS customers FROM k GROUP BY month",
)
def a17_monthly_mrr(spark, sf_dir):
    """Monthly MRR up to the latest complete month."""
    return A.monthly_mrr(Views(spark, sf_dir).v_subs)


_RISK_SCOPE = f"""v AS (SELECT * FROM v_subs WHERE mrr IS NOT NULL AND month IS NOT NULL),
s AS (SELECT * FROM v WHERE month = {latest('v')})"""


@query(
    "a18_risk_customer_ranking",
    f"""WITH {_RISK_SCOPE},
g AS (SELECT customer_id, company, manager, min(renewal_risk) AS renewal_risk, round(sum(mrr), 2) AS mrr, count(*) AS records FROM s
 WHERE {mask('renewal_risk', 'high_risk')} GROUP BY customer_id, company, manager ORDER BY mrr DESC, customer_id, company, manager LIMIT 20)
SELECT *, CAST(row_number() OVER (ORDER BY mrr DESC, customer_id, company, manager) AS INTEGER) AS rank FROM g""",
)
def a18_risk_customer_ranking(spark, sf_dir):
    """Top 20 high-risk customers by MRR in the latest complete month."""
    return A.risk_customer_ranking(Views(spark, sf_dir).v_subs)


@query(
    "a19_risk_customer_summary",
    f"""WITH {_RISK_SCOPE}
SELECT strftime((SELECT max(month) FROM s), '%Y-%m') AS scope, 'high_risk' AS measure, count(DISTINCT CASE WHEN {mask('renewal_risk', 'high_risk')} THEN customer_id END) AS customers,
 round(coalesce(sum(CASE WHEN {mask('renewal_risk', 'high_risk')} THEN mrr END), 0), 2) AS mrr FROM s
UNION ALL SELECT strftime((SELECT max(month) FROM s), '%Y-%m'), 'high_medium_risk', count(DISTINCT CASE WHEN {mask('renewal_risk', 'medium_high')} THEN customer_id END),
 round(coalesce(sum(CASE WHEN {mask('renewal_risk', 'medium_high')} THEN mrr END), 0), 2) FROM s""",
)
def a19_risk_customer_summary(spark, sf_dir):
    """High and high+medium risk customers and MRR."""
    return A.risk_customer_summary(Views(spark, sf_dir).v_subs)


# ---------------------------------------------------------------- A20-A23 --
@query(
    "a20_multi_analysis",
    """SELECT 1 AS q, 'q1_count_by_type' AS table_name, to_json({'dimension': dimension, 'row_count': row_count}) AS row_json
FROM (SELECT event_type AS dimension, count(*) AS row_count FROM events WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1)
UNION ALL SELECT 2, 'q2_monthly_count', to_json({'period': strftime(period, '%Y-%m'), 'orders': orders}) FROM
 (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, count(*) AS orders FROM orders GROUP BY 1)
UNION ALL SELECT 3, 'q3_overview', to_json({'row_count': row_count, 'column_count': 6}) FROM (SELECT count(*) AS row_count FROM orders)""",
)
def a20_multi_analysis(spark, sf_dir):
    """Three operations merged into one long result."""
    v = Views(spark, sf_dir)
    trend = v.orders.groupBy(F.trunc("o_orderdate", "month").alias("p")).agg(F.count(F.lit(1)).alias("orders")).select(
        F.date_format("p", "yyyy-MM").alias("period"), "orders"
    )
    overview = A.dataset_overview(v.orders).select("row_count", "column_count")
    return A.multi_analysis([("count_by_type", A.count_by_dimension(v.events, "event_type")), ("monthly_count", trend), ("overview", overview)])


@query(
    "a22_top_row_insight",
    """WITH t AS (SELECT o_orderpriority AS dimension, sum(o_totalprice) AS v FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1)
SELECT arg_max(dimension, v) AS top_label, round(max(v), 2) AS top_value, count(*) AS row_count FROM t""",
)
def a22_top_row_insight(spark, sf_dir):
    """Label and value of the largest row of an A1 result."""
    t = A.group_aggregate(Views(spark, sf_dir).orders, "o_orderpriority", "o_totalprice", "sum")
    return rnd(A.top_row_insight(t, "dimension", "sum_o_totalprice"), ["top_value"])


@query(
    "a23_chart_series",
    """SELECT CAST(row_number() OVER (ORDER BY period) AS INTEGER) AS pos, CAST(period AS VARCHAR) AS label, round(sum(o_totalprice), 2) AS value
FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, o_totalprice FROM orders) GROUP BY period""",
)
def a23_chart_series(spark, sf_dir):
    """Ordered label/value series of the monthly trend."""
    t = A.time_trend(Views(spark, sf_dir).orders, "o_orderdate", "o_totalprice", "sum")
    return rnd(A.chart_series(t, "period", "sum_o_totalprice"), ["value"])
