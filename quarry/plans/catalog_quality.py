"""Registered queries for Q1–Q17 with DuckDB oracles (SQL generated from the
column list of the audited table, with the same rule order and thresholds)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import quality as Q
from quarry.plans.catalog_profile import DIRTY_COLS
from quarry.plans.registry import query
from quarry.plans.sqlparts import latest
from quarry.sources.views import Views


def _num(c: str) -> str:
    return f"TRY_CAST({c} AS DOUBLE)"


def _pct(x: str) -> str:
    return f"(CASE WHEN {x} <= 1 THEN {x} ELSE {x} / 100 END)"


RULES_DIRTY = [
    ("future_period", "month", "high", "future_period_rows", "month > (SELECT lp FROM f5)"),
    ("negative_mrr", "mrr", "high", "negative_mrr_rows", "mrr < 0"),
    ("extreme_discount", "discount_rate", "warning", "extreme_discount_rows", f"{_pct('discount_rate')} > 0.5"),
    ("zero_amount", "sales", "warning", "zero_value_rows", "coalesce(sales, 1) = 0"),
    ("negative_profit", "profit", "high", "negative_profit_rows", "profit < 0"),
    ("sales_formula", "sales", "high", "formula_error_rows", f"abs(sales - quantity * unit_price * (1 - {_pct('coalesce(discount_rate, 0)')})) > 0.01"),
    ("profit_formula", "profit", "high", "formula_error_rows", "abs(profit - (sales - cost)) > 0.01"),
    ("rate_formula", "profit_rate", "high", "formula_error_rows", "abs(profit_rate - profit / nullif(sales, 0)) > 0.0001"),
]


def _text(i: int) -> str:
    whens = " ".join("WHEN '{}' THEN '{}'".format(kind, texts[i].replace("'", "''")) for kind, texts in Q.ISSUE_TEXTS.items())
    return f"CASE issue_type {whens} END"


_TEXTS = f"""\"column\" || ': ' || CAST(affected AS VARCHAR) || ' ' || {_text(0)} AS detail, {_text(1)} AS suggestion"""


def quality_sql(table: str, cols: list[tuple[str, str]], keys: list[list[str]], rules) -> str:
    names = [c for c, _ in cols]
    all_cols = ", ".join(names)
    parts = [
        f"""SELECT 0 AS position, 'duplicate_rows' AS issue_type, '__row__' AS "column", CASE WHEN v / greatest(r, 1) < 0.05 THEN 'warning' ELSE 'high' END AS severity,
 'duplicate_rows' AS metric, CAST(v AS DOUBLE) AS value, CAST(v AS BIGINT) AS affected FROM (SELECT coalesce(sum(n - 1), 0) AS v FROM (SELECT count(*) AS n FROM {table} GROUP BY {all_cols})), (SELECT count(*) AS r FROM {table}) WHERE v > 0"""
    ]
    for j, k in enumerate(keys):
        parts.append(
            f"SELECT {1 + j}, 'duplicate_key', '{'+'.join(k)}', 'high', 'duplicate_key_rows', CAST(v AS DOUBLE), CAST(v AS BIGINT) FROM "
            f"(SELECT coalesce(sum(n - 1), 0) AS v FROM (SELECT count(*) AS n FROM {table} GROUP BY {', '.join(k)})) WHERE v > 0"
        )
    for i, (c, t) in enumerate(cols):
        base = 10 + i * 10
        st = f"(SELECT count(*) AS r, count_if({c} IS NULL) AS m, count(DISTINCT {c}) AS u FROM {table})"
        parts.append(f"SELECT {base}, 'missing', '{c}', CASE WHEN m / r >= 0.2 THEN 'high' ELSE 'warning' END, 'missing_rate', round(m / r, 4), m FROM {st} WHERE m > 0")
        parts.append(f"SELECT {base + 1}, 'constant', '{c}', 'info', 'unique_count', CAST(u AS DOUBLE), u FROM {st} WHERE r > 1 AND u <= 1")
        if t == "string":
            parts.append(
                f"SELECT {base + 2}, 'high_cardinality', '{c}', 'info', 'unique_rate', round(u / greatest(r - m, 1), 4), u FROM {st} "
                f"WHERE u / greatest(r - m, 1) >= 0.9 AND r >= 20"
            )
        if t in ("string", "bigint", "int", "double"):
            x = _num(c)
            parts.append(
                f"""SELECT {base + 3}, 'iqr_outliers', '{c}', CASE WHEN k / n < 0.1 THEN 'warning' ELSE 'high' END, 'outlier_count', CAST(k AS DOUBLE), k FROM
 (SELECT count({x}) AS n, q3 - q1 AS iqr, count_if({x} < q1 - 1.5 * (q3 - q1) OR {x} > q3 + 1.5 * (q3 - q1)) AS k FROM {table},
 (SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3 FROM {table}) GROUP BY q1, q3) WHERE n >= 8 AND iqr > 0 AND k > 0"""
            )
    for i, (it, c, sev, m, pred) in enumerate(rules):
        parts.append(f"SELECT {100000 + i}, '{it}', '{c}', '{sev}', '{m}', CAST(count_if({pred}) AS DOUBLE), count_if({pred}) FROM {table} HAVING count_if({pred}) > 0")
    body = "\nUNION ALL ".join(parts)
    return f"""WITH f5 AS (SELECT {latest(table)} AS lp), issues AS ({body}), every AS (
SELECT * FROM issues UNION ALL SELECT 1000000000, 'no_issue', '__dataset__', 'info', 'quality_scan', 0.0, 0 WHERE (SELECT count(*) FROM issues) = 0)
SELECT *, {_TEXTS} FROM every"""


Q15_SQL = quality_sql("v_dirty", DIRTY_COLS, [["order_id"], ["customer_id", "month"]], RULES_DIRTY)


@query("q15_quality_issues", Q15_SQL)
def q15_quality_issues(spark, sf_dir):
    """Full audit of v_dirty (Q1–Q14 stacked in rule order)."""
    return Q.quality_issues(Views(spark, sf_dir).v_dirty)


def _issue_sql(types: list[str]) -> str:
    inlist = ", ".join(f"'{t}'" for t in types)
    return f"SELECT * FROM ({Q15_SQL}) WHERE issue_type IN ({inlist})"


def _issue_query(key: str, types: list[str], doc: str):
    def fn(spark, sf_dir):
        return Q.quality_issues(Views(spark, sf_dir).v_dirty).where(F.col("issue_type").isin(types))

    fn.__doc__ = doc
    query(key, _issue_sql(types))(fn)


_issue_query("q1_dup_rows", ["duplicate_rows"], "Exact duplicate rows after the first.")
_issue_query("q2_dup_business_key", ["duplicate_key"], "Duplicate order id and customer+month keys.")
_issue_query("q3_missing", ["missing"], "Columns with missing values and their rate.")
_issue_query("q4_constant", ["constant"], "Columns with at most one distinct value.")
_issue_query("q5_high_cardinality", ["high_cardinality"], "Near-unique text columns.")
_issue_query("q6_iqr_outliers", ["iqr_outliers"], "IQR outliers of every numeric-coercible column.")
_issue_query("q7_future_period", ["future_period"], "Rows in months after the latest complete month.")
_issue_query("q8_negative_mrr", ["negative_mrr"], "Negative MRR rows.")
_issue_query("q9_extreme_discount", ["extreme_discount"], "Discounts above 50 % (percent values normalised).")
_issue_query("q10_zero_amount", ["zero_amount"], "Zero amounts (null is not zero).")
_issue_query("q11_negative_profit", ["negative_profit"], "Negative profit rows.")
_issue_query("q12_sales_formula", ["sales_formula"], "sales ≠ quantity × price × (1 − discount).")
_issue_query("q13_profit_formula", ["profit_formula"], "profit ≠ sales − cost.")
_issue_query("q14_rate_formula", ["rate_formula"], "profit rate ≠ profit / sales.")


@query(
    "q11_negative_profit_sales",
    "SELECT *, " + _TEXTS + " FROM (SELECT 100003 AS position, 'negative_profit' AS issue_type, 'profit' AS \"column\", 'high' AS severity, "
    "'negative_profit_rows' AS metric, CAST(count_if(profit < 0) AS DOUBLE) AS value, count_if(profit < 0) AS affected FROM v_sales HAVING count_if(profit < 0) > 0)",
)
def q11_negative_profit_sales(spark, sf_dir):
    """Negative-profit lines of v_sales."""
    return Q.quality_issues(Views(spark, sf_dir).v_sales).where(F.col("issue_type") == "negative_profit")


@query(
    "q17_severity_summary",
    f"""WITH i AS ({Q15_SQL})
SELECT count_if(issue_type <> 'no_issue') AS issue_count, count_if(severity = 'high') AS high_count, count_if(severity = 'warning') AS warning_count,
 coalesce(max(CASE WHEN issue_type = 'duplicate_rows' THEN value END), 0.0) AS duplicate_rows, arg_min(issue_type, position) AS first_issue FROM i""",
)
def q17_severity_summary(spark, sf_dir):
    """Totals by severity and the first issue of the v_dirty audit."""
    return Q.severity_summary(Q.quality_issues(Views(spark, sf_dir).v_dirty))


def _detail_sql() -> str:
    preds = [
        ("duplicate_rows", "dup_row"),
        ("duplicate_key", "dup_k0"),
        ("duplicate_key", "dup_k1"),
    ] + [(it, f"coalesce({pred}, false)") for it, _, _, _, pred in RULES_DIRTY]
    cols = ", ".join(c for c, _ in DIRTY_COLS)
    flagged = f"""fl AS (SELECT d.*,
 EXISTS (SELECT 1 FROM (SELECT {cols} FROM v_dirty GROUP BY {cols} HAVING count(*) > 1) g WHERE {' AND '.join(f'g.{c} IS NOT DISTINCT FROM d.{c}' for c, _ in DIRTY_COLS)}) AS dup_row,
 EXISTS (SELECT 1 FROM (SELECT order_id FROM v_dirty GROUP BY order_id HAVING count(*) > 1) g WHERE g.order_id IS NOT DISTINCT FROM d.order_id) AS dup_k0,
 EXISTS (SELECT 1 FROM (SELECT customer_id, month FROM v_dirty GROUP BY customer_id, month HAVING count(*) > 1) g WHERE g.customer_id IS NOT DISTINCT FROM d.customer_id AND g.month IS NOT DISTINCT FROM d.month) AS dup_k1
 FROM v_dirty d)"""
    tags = " UNION ALL ".join(f"SELECT {i} AS p, '{name}' AS issue_type, {cols} FROM fl WHERE {pred}" for i, (name, pred) in enumerate(preds))
    return f"""WITH f5 AS (SELECT {latest('v_dirty')} AS lp), {flagged}, t AS ({tags})
SELECT CAST(p AS INTEGER) AS issue_position, issue_type, {cols} FROM t ORDER BY p, order_id"""


@query("q16_quality_detail_rows", _detail_sql())
def q16_quality_detail_rows(spark, sf_dir):
    """Every whole row of every row-level issue, ordered by order_id."""
    return Q.quality_detail_rows(Views(spark, sf_dir).v_dirty, ["order_id"])


@query(
    "q15_audit_metrics",
    f"""SELECT (SELECT count(*) FROM v_dirty) AS row_count, {len(DIRTY_COLS)} AS column_count, count_if(issue_type <> 'no_issue') AS issue_count,
 coalesce(max(CASE WHEN issue_type = 'duplicate_rows' THEN affected END), 0) AS duplicate_count, (SELECT count(*) FROM ({_detail_sql()})) AS detail_row_count
FROM ({Q15_SQL})""",
)
def q15_audit_metrics(spark, sf_dir):
    """Rows, columns, issues, duplicate rows and listed rows of the v_dirty audit."""
    return Q.audit_metrics(Views(spark, sf_dir).v_dirty)
