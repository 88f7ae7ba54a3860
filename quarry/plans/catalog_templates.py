"""Registered queries for T1–T15 over the derived views, with DuckDB oracles."""

from __future__ import annotations

from quarry.operators import templates as T
from quarry.plans.registry import query
from quarry.plans.sqlparts import guarded_corr, latest, margin, mask
from quarry.sources.views import Views

ALL = "全期间"

# ---------------------------------------------------------------- T1 -------
_T1_W = f"""w AS (SELECT *, {mask('payment_status', 'payment_issue')} AS issue, coalesce(invoice_amount, 0) AS inv, coalesce(mrr, 0) AS m FROM v_subs),
iss AS (SELECT * FROM w WHERE issue),
il AS (SELECT {latest('iss')} AS lp),
al AS (SELECT {latest('w')} AS lp),
si AS (SELECT * FROM iss WHERE month = (SELECT lp FROM il)),
sa AS (SELECT * FROM w WHERE month = (SELECT lp FROM al))"""


def _row(scope: str, measure: str, src: str, cond: str, val: str) -> str:
    return (
        f"SELECT {scope} AS scope, '{measure}' AS measure, count_if({cond}) AS records, "
        f"count(DISTINCT CASE WHEN {cond} THEN customer_id END) AS customers, "
        f"round(coalesce(sum(CASE WHEN {cond} THEN {val} END), 0), 2) AS amount FROM {src}"
    )


@query(
    "t1a_payment_renewal_summary",
    f"WITH {_T1_W}\n"
    + "\nUNION ALL ".join(
        [
            _row(f"'{ALL}'", "problem_invoices", "iss", "TRUE", "inv"),
            _row("strftime((SELECT lp FROM il), '%Y-%m')", "problem_invoices_in_scope", "si", "TRUE", "inv"),
            _row(f"'{ALL}'", "overdue_45_days", "iss", "overdue_days >= 45", "inv"),
            _row("strftime((SELECT lp FROM il), '%Y-%m')", "high_risk_problem", "si", mask("renewal_risk", "high_risk"), "inv"),
            _row("strftime((SELECT lp FROM il), '%Y-%m')", "high_medium_risk_problem", "si", mask("renewal_risk", "medium_high"), "inv"),
            _row("strftime((SELECT lp FROM al), '%Y-%m')", "high_risk_mrr", "sa", mask("renewal_risk", "high_risk"), "m"),
        ]
    ),
)
def t1a_payment_renewal_summary(spark, sf_dir):
    """Problem invoices all-time/in scope, overdue ≥ 45 d, risk × problem, high-risk MRR."""
    return T.payment_renewal_summary(Views(spark, sf_dir).v_subs)


@query(
    "t1b_collection_priority",
    f"""WITH {_T1_W}
SELECT customer_id, company, manager, payment_status, renewal_risk, round(invoice_amount, 2) AS invoice_amount, overdue_days, round(mrr, 2) AS mrr, month
FROM si ORDER BY invoice_amount DESC, overdue_days DESC, customer_id, company, manager, payment_status, renewal_risk, overdue_days, mrr, month LIMIT 20""",
)
def t1b_collection_priority(spark, sf_dir):
    """Scoped problem invoices by amount and overdue days, top 20."""
    return T.collection_priority(Views(spark, sf_dir).v_subs)


@query(
    "t2_customer_success_priority",
    f"""WITH al AS (SELECT {latest('v_subs')} AS lp),
g AS (SELECT manager, count(DISTINCT customer_id) AS customers, round(sum(coalesce(mrr, 0)), 2) AS total_mrr,
 count(DISTINCT CASE WHEN {mask('renewal_risk', 'high_risk')} THEN customer_id END) AS high_risk_customers,
 round(coalesce(sum(CASE WHEN {mask('renewal_risk', 'high_risk')} THEN coalesce(mrr, 0) END), 0), 2) AS high_risk_mrr,
 round(coalesce(sum(CASE WHEN {mask('renewal_risk', 'medium_high')} THEN coalesce(mrr, 0) END), 0), 2) AS high_medium_risk_mrr,
 round(sum(CASE WHEN {mask('payment_status', 'payment_issue')} THEN coalesce(invoice_amount, 0) ELSE 0 END), 2) AS problem_invoice_amount
 FROM v_subs WHERE month = (SELECT lp FROM al) GROUP BY manager)
SELECT *, CAST(row_number() OVER (ORDER BY high_risk_mrr DESC, problem_invoice_amount DESC, total_mrr DESC, manager) AS INTEGER) AS priority FROM g""",
)
def t2_customer_success_priority(spark, sf_dir):
    """Per manager in the latest complete month, numbered by risk exposure."""
    return T.customer_success_priority(Views(spark, sf_dir).v_subs)


def _dim_risk_sql(dim: str, src: str = "v_subs", where: str = "TRUE") -> str:
    return f"""SELECT {dim}, count(*) AS records, count(DISTINCT customer_id) AS customers,
 round(sum(coalesce(mrr, 0)), 2) AS metric_sum, round(avg(coalesce(mrr, 0)), 2) AS metric_mean,
 count_if({mask('renewal_risk', 'high_risk')}) AS high_risk_records, count_if({mask('churn', 'yes')}) AS churn_records,
 round(avg(coalesce(nps, 0)), 2) AS avg_nps,
 round(coalesce(count_if({mask('renewal_risk', 'high_risk')}) / nullif(count(*), 0), 0), 4) AS high_risk_rate,
 round(coalesce(count_if({mask('churn', 'yes')}) / nullif(count(*), 0), 0), 4) AS churn_rate
FROM {src} WHERE {where} GROUP BY {dim}"""


@query("t3_dimension_risk", _dim_risk_sql("manager", where="month = DATE '1998-03-01'"))
def t3_dimension_risk(spark, sf_dir):
    """Shared dimension-risk table, by manager, explicit period 1998-03."""
    v = Views(spark, sf_dir).v_subs
    return T.dimension_risk(v, "manager", period="1998-03")


@query("t4_channel_performance_risk", _dim_risk_sql("channel"))
def t4_channel_performance_risk(spark, sf_dir):
    """T3 by acquisition channel over all periods."""
    return T.channel_performance_risk(Views(spark, sf_dir).v_subs)


@query("t5_industry_market_selection", _dim_risk_sql("industry", where="month(month) = 3"))
def t5_industry_market_selection(spark, sf_dir):
    """T3 by industry, month-of-year 3 across all years."""
    return T.industry_market_selection(Views(spark, sf_dir).v_subs, month=3)


@query(
    "t6_segment_plan_strategy",
    "SELECT 'segment' AS dimension_type, CAST(segment AS VARCHAR) AS dimension_value, * EXCLUDE (segment) FROM ("
    + _dim_risk_sql("segment")
    + ") UNION ALL SELECT 'plan', CAST(plan AS VARCHAR), * EXCLUDE (plan) FROM ("
    + _dim_risk_sql("plan")
    + ")",
)
def t6_segment_plan_strategy(spark, sf_dir):
    """T3 by segment and by plan, stacked."""
    return T.segment_plan_strategy(Views(spark, sf_dir).v_subs)


_T7_PANEL = f"""b AS (SELECT (SELECT min(month) FROM v_subs WHERE month IS NOT NULL) AS fp, {latest('v_subs')} AS lp),
f AS (SELECT customer_id, arg_min(coalesce(mrr, 0), row_key) AS mrr_first, arg_min(company, row_key) AS company FROM v_subs WHERE month = (SELECT fp FROM b) GROUP BY customer_id),
l AS (SELECT customer_id, arg_min(coalesce(mrr, 0), row_key) AS mrr_last FROM v_subs WHERE month = (SELECT lp FROM b) GROUP BY customer_id),
panel AS (SELECT f.customer_id, mrr_first, company, mrr_last, mrr_last - mrr_first AS mrr_change,
 CASE WHEN mrr_last - mrr_first > 0 THEN 'expansion' WHEN mrr_last - mrr_first < 0 THEN 'contraction' ELSE 'flat' END AS change_type,
 strftime((SELECT fp FROM b), '%Y-%m') AS first_month, strftime((SELECT lp FROM b), '%Y-%m') AS last_month
 FROM f JOIN l ON f.customer_id = l.customer_id)"""


def _panel(spark, sf_dir):
    return T.expansion_panel(Views(spark, sf_dir).v_subs, order_key="row_key")


@query("t7a_expansion_panel", f"WITH {_T7_PANEL} SELECT * FROM panel")
def t7a_expansion_panel(spark, sf_dir):
    """Customers in first and last month with MRR delta."""
    return _panel(spark, sf_dir)


@query(
    "t7b_expansion_summary",
    f"""WITH {_T7_PANEL}
SELECT 'expansion' AS type, count_if(mrr_change > 0) AS customers, round(coalesce(sum(CASE WHEN mrr_change > 0 THEN mrr_change END), 0), 2) AS mrr_change FROM panel
UNION ALL SELECT 'contraction', count_if(mrr_change < 0), round(coalesce(sum(CASE WHEN mrr_change < 0 THEN mrr_change END), 0), 2) FROM panel
UNION ALL SELECT 'net', count(*), round(coalesce(sum(mrr_change), 0), 2) FROM panel""",
)
def t7b_expansion_summary(spark, sf_dir):
    """Expansion / contraction / net customers and MRR change."""
    return T.expansion_summary(_panel(spark, sf_dir))


@query(
    "t7c_top_movers",
    f"""WITH {_T7_PANEL}
SELECT * FROM (SELECT *, 'expansion' AS direction FROM panel WHERE mrr_change > 0 ORDER BY mrr_change DESC, customer_id LIMIT 20)
UNION ALL SELECT * FROM (SELECT *, 'contraction' AS direction FROM panel WHERE mrr_change < 0 ORDER BY mrr_change ASC, customer_id LIMIT 20)""",
)
def t7c_top_movers(spark, sf_dir):
    """Top 20 expansions and top 20 contractions."""
    return T.top_movers(_panel(spark, sf_dir), "customer_id")


_RISK_CODE = "CASE WHEN contains(renewal_risk, '高') THEN 3.0 WHEN contains(renewal_risk, '中') THEN 2.0 WHEN contains(renewal_risk, '低') THEN 1.0 WHEN contains(lower(renewal_risk), 'high') THEN 3.0 WHEN contains(lower(renewal_risk), 'medium') THEN 2.0 WHEN contains(lower(renewal_risk), 'low') THEN 1.0 END"
_T8_PAIRS = [
    ("usage vs mrr", "usage_hours", "mrr", "usage_hours", "mrr"),
    ("active users vs mrr", "active_users", "mrr", "active_users", "mrr"),
    ("tickets vs renewal risk", "tickets", "renewal_risk", "tickets", "rc"),
    ("sla breaches vs renewal risk", "sla_breaches", "renewal_risk", "sla_breaches", "rc"),
    ("nps vs renewal risk", "nps", "renewal_risk", "nps", "rc"),
    ("csat vs renewal risk", "csat", "renewal_risk", "csat", "rc"),
    ("csat vs nps", "csat", "nps", "csat", "nps"),
]


@query(
    "t8_health_signal_correlations",
    "WITH s AS (SELECT *, "
    + _RISK_CODE
    + " AS rc FROM v_subs), r AS ("
    + " UNION ALL ".join(
        f"SELECT '{lab}' AS relation, '{fa}' AS field_a, '{fb}' AS field_b, round({guarded_corr(a, b)}, 4) AS r, count_if({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM s"
        for lab, fa, fb, a, b in _T8_PAIRS
    )
    + ") SELECT * FROM r WHERE n >= 3 AND r IS NOT NULL",
)
def t8_health_signal_correlations(spark, sf_dir):
    """Seven named health-signal correlations in one aggregate."""
    return T.health_signal_correlations(Views(spark, sf_dir).v_subs)


# ---------------------------------------------------------------- T9-T14 ---
@query(
    "t9_sales_overview_status",
    f"""WITH a AS (SELECT count(*) AS n_all, round(sum(coalesce(sales, 0)), 2) AS s_all, round(sum(coalesce(profit, 0)), 2) AS p_all,
 count_if({mask('status', 'completed')}) AS n_done,
 round(coalesce(sum(CASE WHEN {mask('status', 'completed')} THEN coalesce(sales, 0) END), 0), 2) AS s_done,
 round(coalesce(sum(CASE WHEN {mask('status', 'completed')} THEN coalesce(profit, 0) END), 0), 2) AS p_done FROM v_sales)
SELECT 'all_orders' AS scope, n_all AS orders, s_all AS sales, p_all AS profit, {margin('p_all', 's_all')} AS margin, CAST(NULL AS DOUBLE) AS sales_share FROM a
UNION ALL SELECT 'completed_orders', n_done, s_done, p_done, {margin('p_done', 's_done')}, round(coalesce(s_done / nullif(s_all, 0), 0), 4) FROM a""",
)
def t9_sales_overview_status(spark, sf_dir):
    """All vs completed orders: count, sales, profit, margin, share."""
    return T.sales_overview_status(Views(spark, sf_dir).v_sales)


def _sales_group_sql(dim: str, extra: str = "") -> str:
    return f"""SELECT {dim}, count(*) AS orders, round(sum(coalesce(sales, 0)), 2) AS sales, round(sum(coalesce(profit, 0)), 2) AS profit,
 {margin('round(sum(coalesce(profit, 0)), 2)', 'round(sum(coalesce(sales, 0)), 2)')} AS margin{extra} FROM v_sales GROUP BY {dim}"""


@query("t10_order_status_impact", _sales_group_sql("status"))
def t10_order_status_impact(spark, sf_dir):
    """Per order status: orders, sales, profit, margin."""
    return T.order_status_impact(Views(spark, sf_dir).v_sales)


_TOTAL = "(SELECT greatest(sum(coalesce(sales, 0)), 1.0) FROM v_sales)"


@query(
    "t11_product_pareto",
    f"""WITH g AS ({_sales_group_sql('product', f", round(round(sum(coalesce(sales, 0)), 2) / {_TOTAL}, 4) AS sales_share")}),
top AS (SELECT * FROM g ORDER BY sales DESC, product LIMIT 20)
SELECT *, round(sum(sales_share) OVER (ORDER BY sales DESC, product ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS cumulative_share FROM top""",
)
def t11_product_pareto(spark, sf_dir):
    """Top 20 products with share and cumulative share."""
    return T.product_pareto(Views(spark, sf_dir).v_sales)


@query(
    "t12a_discount_profit_by_rate",
    "SELECT discount_rate, count(*) AS orders, round(avg(coalesce(profit_rate, 0)), 4) AS avg_profit_rate FROM v_sales GROUP BY discount_rate",
)
def t12a_discount_profit_by_rate(spark, sf_dir):
    """Per discount value: orders and mean profit rate."""
    return T.discount_profit_by_rate(Views(spark, sf_dir).v_sales)


@query(
    "t12b_discount_profit_corr",
    f"SELECT round({guarded_corr('coalesce(discount_rate, 0)', 'coalesce(profit_rate, 0)')}, 4) AS correlation, count(*) AS n FROM v_sales",
)
def t12b_discount_profit_corr(spark, sf_dir):
    """Correlation of discount and profit rate (missing as 0)."""
    return T.discount_profit_corr(Views(spark, sf_dir).v_sales)


@query(
    "t12c_discount_anomalies",
    "SELECT order_id, discount_rate, sales, profit, profit_rate FROM v_sales WHERE coalesce(profit, 0) < 0 "
    "ORDER BY order_id, discount_rate, sales, profit, profit_rate LIMIT 20",
)
def t12c_discount_anomalies(spark, sf_dir):
    """First 20 negative-profit order lines."""
    return T.discount_anomalies(Views(spark, sf_dir).v_sales)


@query("t13_payment_mix", _sales_group_sql("payment_method", f", round(round(sum(coalesce(sales, 0)), 2) / {_TOTAL}, 4) AS sales_share"))
def t13_payment_mix(spark, sf_dir):
    """Per payment method with share of total sales."""
    return T.payment_mix(Views(spark, sf_dir).v_sales)


@query(
    "t14_sales_channel_strategy",
    _sales_group_sql(
        "channel",
        f", round(CASE WHEN channel IS NOT NULL THEN avg(CAST({mask('status', 'cancelled')} AS DOUBLE)) END, 4) AS cancel_rate"
        f", round(CASE WHEN channel IS NOT NULL THEN avg(CAST({mask('status', 'returned')} AS DOUBLE)) END, 4) AS return_rate",
    ),
)
def t14_sales_channel_strategy(spark, sf_dir):
    """Per channel with cancel and return rates."""
    return T.sales_channel_strategy(Views(spark, sf_dir).v_sales)


# ---------------------------------------------------------------- T15 ------
_PIPE_W = f"""pw AS (SELECT *, coalesce(amount, 0) AS a, coalesce(amount, 0) * CASE WHEN coalesce(win_rate, 0) <= 1 THEN coalesce(win_rate, 0) ELSE coalesce(win_rate, 0) / 100 END AS wt,
 {mask('stage', 'won')} AS won FROM v_pipe)"""


@query(
    "t15a_pipeline_summary",
    f"""WITH {_PIPE_W}
SELECT 'total_pipeline' AS measure, round(sum(a), 2) AS pipeline_amount FROM pw
UNION ALL SELECT 'weighted_pipeline', round(sum(wt), 2) FROM pw
UNION ALL SELECT 'won_amount', round(coalesce(sum(CASE WHEN won THEN a END), 0), 2) FROM pw""",
)
def t15a_pipeline_summary(spark, sf_dir):
    """Total, weighted and won pipeline."""
    return T.pipeline_summary(Views(spark, sf_dir).v_pipe)


def _pipe_by_sql(key: str, won: bool = False) -> str:
    extra = ", round(sum(CASE WHEN won THEN a ELSE 0 END), 2) AS won_amount" if won else ""
    return f"WITH {_PIPE_W} SELECT {key}, count(*) AS deals, round(sum(a), 2) AS total_pipeline, round(sum(wt), 2) AS weighted_pipeline{extra} FROM pw GROUP BY {key}"


@query("t15b_pipeline_by_owner", _pipe_by_sql("owner", won=True))
def t15b_pipeline_by_owner(spark, sf_dir):
    """Pipeline per owner, with won amount."""
    return T.pipeline_by(Views(spark, sf_dir).v_pipe, by="owner")


@query("t15c_pipeline_by_stage", _pipe_by_sql("stage"))
def t15c_pipeline_by_stage(spark, sf_dir):
    """Pipeline per stage."""
    return T.pipeline_by(Views(spark, sf_dir).v_pipe, by="stage")


@query("t15d_pipeline_by_type", _pipe_by_sql("deal_type"))
def t15d_pipeline_by_type(spark, sf_dir):
    """Pipeline per deal type."""
    return T.pipeline_by(Views(spark, sf_dir).v_pipe, by="type")


@query(
    "t15_pipeline_breakdown",
    f"""WITH {_PIPE_W}
SELECT CASE WHEN grouping(owner) = 0 THEN 'owner' WHEN grouping(stage) = 0 THEN 'stage' ELSE 'deal_type' END AS dimension_type,
 CAST(CASE WHEN grouping(owner) = 0 THEN owner WHEN grouping(stage) = 0 THEN stage ELSE deal_type END AS VARCHAR) AS dimension_value,
 count(*) AS deals, round(sum(a), 2) AS total_pipeline, round(sum(wt), 2) AS weighted_pipeline, round(sum(CASE WHEN won THEN a ELSE 0 END), 2) AS won_amount
FROM pw GROUP BY GROUPING SETS ((owner), (stage), (deal_type))""",
)
def t15_pipeline_breakdown(spark, sf_dir):
    """Owner, stage and type breakdowns in one GROUPING SETS pass."""
    return T.pipeline_breakdown(Views(spark, sf_dir).v_pipe)
