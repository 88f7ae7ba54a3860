"""Q1–Q17: the data-quality audit.

Plan shape (independent of the number of columns or rules):
  * one aggregate for per-column missing counts and the distinct counts the
    rules need (exact only for text columns; min = max elsewhere),
  * one sort for all IQR quartiles (:mod:`quarry.functions.quantiles`) plus
    one pass counting outliers against the broadcast bound table,
  * one grouped count per duplicate rule (row fingerprints, each business key),
  * ONE aggregate holding every row-level business rule as ``count_if``,
then all candidate issues are stacked, filtered to those that fire, and
ordered by the reference's position (rows, keys, per-column, business).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StringType, TimestampNTZType, TimestampType

from quarry.functions.columns import latest_complete_period, month_of, num, num_in, percent_normalise, best_match
from quarry.functions.fingerprints import PRINT, fingerprint, repeated_rows, same_row
from quarry.functions.quantiles import quantile_row

# Keyword lists the audit uses to find business columns.
QUALITY_KEYWORDS = {
    "order_key": ["订单ID", "订单编号", "order_id", "order id"],
    "customer_key": ["客户ID", "客户编号", "customer_id", "customer id"],
    "key_month": ["统计月份", "月份", "month", "billing_month"],
    "time": ["统计月份", "月份", "month", "date", "日期"],
    "sales": ["销售额", "订单金额", "发票金额", "sales", "revenue", "amount", "mrr"],
    "mrr": ["月经常性收入MRR", "mrr", "月经常性收入"],
    "profit": ["利润", "profit"],
    "cost": ["成本", "cost"],
    "quantity": ["数量", "件数", "units", "quantity", "qty"],
    "unit_price": ["单价", "unit_price", "price"],
    "discount": ["折扣率", "discount_rate", "discount"],
    "profit_rate": ["利润率", "profit_rate", "margin_rate"],
}
# Thresholds of the rules.
DUP_HIGH_SHARE = 0.05
MISSING_HIGH_RATE = 0.2
HIGH_CARDINALITY_RATE = 0.9
HIGH_CARDINALITY_MIN_ROWS = 20
IQR_MIN_VALUES = 8
OUTLIER_HIGH_SHARE = 0.1
EXTREME_DISCOUNT = 0.5
AMOUNT_TOLERANCE = 0.01
RATE_TOLERANCE = 0.0001

# What an issue's ``affected`` counts, and what to do about it.
ISSUE_TEXTS = {
    "duplicate_rows": ("rows repeat an earlier row", "Find out whether the source delivers rows twice, then keep one row per business key."),
    "duplicate_key": ("rows repeat an earlier key", "Decide per key whether these are repeats, snapshots or versions to keep."),
    "missing": ("values are missing", "Settle what a missing value means before filling, dropping or marking it."),
    "constant": ("distinct values", "Leave the column out of models unless it is filtered or grouped by."),
    "high_cardinality": ("distinct values, like an id or free text", "Use it to name rows or bucket it; do not group by it."),
    "iqr_outliers": ("values lie outside the IQR fences", "Check for entry errors and rare cases before trimming."),
    "future_period": ("rows lie after the latest complete month", "Report them apart from closed months."),
    "negative_mrr": ("rows have negative recurring revenue", "Check for refunds and credits booked as revenue."),
    "extreme_discount": ("rows have a discount above one half", "Check approvals and whether the rate is a percentage."),
    "zero_amount": ("rows have a zero amount", "Separate trials and cancelled orders from sales."),
    "negative_profit": ("rows have negative profit", "Check discounts, costs and returns; report these rows apart."),
    "sales_formula": ("rows differ from quantity x price x (1 - discount)", "Check the four columns' sources before using discounts."),
    "profit_formula": ("rows differ from sales - cost", "Check how cost and profit are made before using profit."),
    "rate_formula": ("rows differ from profit / sales", "Check whether the rate is a percentage or has another base."),
    "no_issue": ("issues found", "Value ranges, allowed values and keys still need business rules."),
}

ISSUE_SCHEMA = (
    "position int, issue_type string, column string, severity string, metric string, value double, "
    "affected long, detail string, suggestion string"
)


def _roles(df: DataFrame) -> dict[str, str | None]:
    return {k: best_match(df.columns, v) for k, v in QUALITY_KEYWORDS.items()}


def business_keys(df: DataFrame) -> list[list[str]]:
    r = _roles(df)
    keys = []
    if r["order_key"]:
        keys.append([r["order_key"]])
    if r["customer_key"] and r["key_month"]:
        keys.append([r["customer_key"], r["key_month"]])
    return keys


def _coercible(df: DataFrame) -> list[str]:
    """Columns the IQR rule may read as numbers (numeric, or text parsed)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (NumericType, StringType))]


def _row_rules(df: DataFrame) -> list[tuple[str, str, str, str, Column]]:
    """(issue_type, column, severity, metric, predicate) of the row rules
    Q8–Q14 that apply to this table (Q7 needs the F5 table, added apart)."""
    r = _roles(df)
    rules = []
    if r["mrr"]:
        rules.append(("negative_mrr", r["mrr"], "high", "negative_mrr_rows", num(r["mrr"]) < 0))
    if r["discount"]:
        rules.append(("extreme_discount", r["discount"], "warning", "extreme_discount_rows", percent_normalise(num(r["discount"])) > EXTREME_DISCOUNT))
    if r["sales"]:
        rules.append(("zero_amount", r["sales"], "warning", "zero_value_rows", F.coalesce(num(r["sales"]), F.lit(1.0)) == 0))
    if r["profit"]:
        rules.append(("negative_profit", r["profit"], "high", "negative_profit_rows", num(r["profit"]) < 0))
    if r["sales"] and r["quantity"] and r["unit_price"] and r["discount"]:
        d = percent_normalise(F.coalesce(num(r["discount"]), F.lit(0.0)))
        expected = num(r["quantity"]) * num(r["unit_price"]) * (1 - d)
        rules.append(("sales_formula", r["sales"], "high", "formula_error_rows", F.abs(num(r["sales"]) - expected) > AMOUNT_TOLERANCE))
    if r["profit"] and r["sales"] and r["cost"]:
        rules.append(("profit_formula", r["profit"], "high", "formula_error_rows", F.abs(num(r["profit"]) - (num(r["sales"]) - num(r["cost"]))) > AMOUNT_TOLERANCE))
    if r["profit_rate"] and r["profit"] and r["sales"]:
        expected = F.try_divide(num(r["profit"]), F.when(num(r["sales"]) != 0, num(r["sales"])))
        rules.append(("rate_formula", r["profit_rate"], "high", "formula_error_rows", F.abs(num(r["profit_rate"]) - expected) > RATE_TOLERANCE))
    return rules


def _with_future_flag(df: DataFrame) -> tuple[DataFrame, str | None]:
    """Adds ``_future`` (row month after the F5 month) via a broadcast of the
    one-row F5 table; returns the time column used."""
    t = _roles(df)["time"]
    if not t or not isinstance(df.schema[t].dataType, (DateType, TimestampType, TimestampNTZType, StringType)):
        return df.withColumn("_future", F.lit(False)), None
    w = df.withColumn("_p", month_of(df, t))
    latest = latest_complete_period(w, "_p")
    out = w.crossJoin(F.broadcast(latest)).withColumn("_future", F.coalesce(F.col("_p") > F.col("latest_period"), F.lit(False)))
    return out.drop("_p", "latest_period"), t


def _audit_stats(df: DataFrame, approx: bool = False) -> DataFrame:
    """Per column: missing count/rate, and the distinct count the rules need.
    Exact distinct counts (which Spark evaluates by expanding every row once
    per distinct column) are only needed for text columns (high-cardinality
    rule); for the others "at most one value" is min = max over non-null
    values, so their unique_count is 0, 1, or 2 meaning "more than one"."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, f in enumerate(df.schema.fields):
        x = F.col(f.name)
        tn = f.dataType.typeName()
        if tn in ("double", "float"):
            miss, val = x.isNull() | F.isnan(x), F.when(~F.isnan(x), x)
        else:
            miss, val = x.isNull(), x
        aggs.append(F.count_if(miss).alias(f"m{i}"))
        if isinstance(f.dataType, StringType):
            aggs.append((F.approx_count_distinct(val) if approx else F.count_distinct(val)).alias(f"u{i}"))
        elif tn in ("map", "variant", "binary"):
            aggs.append(F.lit(2).alias(f"u{i}"))
        else:
            aggs.append(
                F.when(F.count(val) == 0, 0).when(F.min(val) == F.max(val), 1).otherwise(2).alias(f"u{i}")
            )
    one = df.agg(*aggs)
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column"),
            F.col(f"m{i}").alias("missing_count"),
            F.round(F.coalesce(F.try_divide(F.col(f"m{i}"), F.col("_rows")), F.lit(0.0)), 4).alias("missing_rate"),
            F.col(f"u{i}").cast("bigint").alias("unique_count"),
            F.col("_rows").alias("row_count"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def quality_issues(df: DataFrame, approx: bool = False) -> DataFrame:
    """Q15 (with Q1–Q14): one row per fired issue, or a single "no issue" row.
    ``affected`` is the number that ``detail`` states: rows, or distinct values."""
    spark = df.sparkSession
    cols = df.columns
    parts: list[DataFrame] = []

    # Q1 duplicate rows and Q2 duplicate business keys: sum(n - 1) over groups
    rows = df.agg(F.count(F.lit(1)).alias("_rows"))
    dup = repeated_rows(df).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("v"))
    dup = dup.crossJoin(rows).select(
        F.lit(0).alias("position"), F.lit("duplicate_rows").alias("issue_type"), F.lit("__row__").alias("column"),
        F.when(F.col("v") / F.greatest(F.col("_rows"), F.lit(1)) < DUP_HIGH_SHARE, "warning").otherwise("high").alias("severity"),
        F.lit("duplicate_rows").alias("metric"), F.col("v").cast("double").alias("value"),
    )
    parts.append(dup)
    for j, key in enumerate(business_keys(df)):
        k = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("v"))
        parts.append(k.select(
            F.lit(1 + j).alias("position"), F.lit("duplicate_key").alias("issue_type"), F.lit("+".join(key)).alias("column"),
            F.lit("high").alias("severity"), F.lit("duplicate_key_rows").alias("metric"), F.col("v").cast("double").alias("value"),
        ))

    # Q3–Q5 from one aggregate over all columns
    stats = _audit_stats(df, approx=approx)
    text_cols = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    nonnull = F.greatest(F.col("row_count") - F.col("missing_count"), F.lit(1))
    base_pos = F.lit(10) + F.col("position") * 10
    missing = stats.select(
        (base_pos + 0).alias("position"), F.lit("missing").alias("issue_type"), "column",
        F.when(F.col("missing_count") >= MISSING_HIGH_RATE * F.col("row_count"), "high").otherwise("warning").alias("severity"),
        F.lit("missing_rate").alias("metric"), F.col("missing_rate").alias("value"), (F.col("missing_count") > 0).alias("_fire"),
        F.col("missing_count").alias("affected"),
    )
    constant = stats.select(
        (base_pos + 1).alias("position"), F.lit("constant").alias("issue_type"), "column", F.lit("info").alias("severity"),
        F.lit("unique_count").alias("metric"), F.col("unique_count").cast("double").alias("value"),
        ((F.col("row_count") > 1) & (F.col("unique_count") <= 1)).alias("_fire"), F.col("unique_count").alias("affected"),
    )
    rate = F.round(F.col("unique_count") / nonnull, 4)
    highcard = stats.select(
        (base_pos + 2).alias("position"), F.lit("high_cardinality").alias("issue_type"), "column", F.lit("info").alias("severity"),
        F.lit("unique_rate").alias("metric"), rate.alias("value"),
        (F.col("column").isin(text_cols) & (F.col("unique_count") / nonnull >= HIGH_CARDINALITY_RATE) & (F.col("row_count") >= HIGH_CARDINALITY_MIN_ROWS)).alias("_fire"),
        F.col("unique_count").alias("affected"),
    )
    for p in (missing, constant, highcard):
        parts.append(p.where("_fire").drop("_fire"))

    # Q6 IQR outliers over every numeric-coercible column: bracket, select, count
    coercible = _coercible(df)
    if coercible:
        pos_of = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])
        x = {c: num_in(df, c) for c in coercible}
        both = df.crossJoin(F.broadcast(quantile_row(df, x, [0.25, 0.75], approx).withColumnRenamed("_q", "_quartiles")))  # one row
        one = []
        for i, (c, v) in enumerate(x.items()):
            q1, q3 = F.col("_quartiles")[i][0], F.col("_quartiles")[i][1]
            reach = 1.5 * (q3 - q1)
            one.append(
                F.struct(
                    F.lit(c).alias("column"), F.count(v).alias("n"), F.first(q3 - q1).alias("iqr"), F.count_if((v < q1 - reach) | (v > q3 + reach)).alias("k")
                )
            )
        o = both.agg(F.array(*one).alias("_m")).select(F.inline("_m"))
        parts.append(o.where((F.col("n") >= IQR_MIN_VALUES) & (F.col("iqr") > 0) & (F.col("k") > 0)).select(
            (F.lit(13) + pos_of[F.col("column")] * 10).cast("int").alias("position"), F.lit("iqr_outliers").alias("issue_type"), "column",
            F.when(F.col("k") / F.col("n") < OUTLIER_HIGH_SHARE, "warning").otherwise("high").alias("severity"),
            F.lit("outlier_count").alias("metric"), F.col("k").cast("double").alias("value"),
        ))

    # Q7–Q14 in ONE aggregate
    flagged, tcol = _with_future_flag(df)
    rules = ([("future_period", tcol, "high", "future_period_rows", F.col("_future"))] if tcol else []) + _row_rules(df)
    if rules:
        agg = flagged.agg(*[F.count_if(pred).alias(f"r{i}") for i, (*_, pred) in enumerate(rules)])
        structs = [
            F.struct(F.lit(100000 + i).alias("position"), F.lit(it).alias("issue_type"), F.lit(c).alias("column"), F.lit(sev).alias("severity"),
                     F.lit(m).alias("metric"), F.col(f"r{i}").cast("double").alias("value"))
            for i, (it, c, sev, m, _) in enumerate(rules)
        ]
        parts.append(agg.select(F.explode(F.array(*structs)).alias("r")).select("r.*"))

    issues = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    # missing / constant / high-cardinality rows are already filtered; the
    # count-based rules fire when their count is positive
    fired = issues.where(F.col("issue_type").isin("missing", "constant", "high_cardinality") | (F.col("value") > 0))
    none = fired.agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") == 0).select(
        F.lit(10**9).alias("position"), F.lit("no_issue").alias("issue_type"), F.lit("__dataset__").alias("column"),
        F.lit("info").alias("severity"), F.lit("quality_scan").alias("metric"), F.lit(0.0).alias("value"),
    )
    texts = spark.createDataFrame([(kind, *t) for kind, t in ISSUE_TEXTS.items()], "issue_type string, _unit string, suggestion string")
    whole = fired.unionByName(none, allowMissingColumns=True).withColumn("position", F.col("position").cast("int"))
    affected = F.coalesce(F.col("affected"), F.col("value").cast("long"))
    return whole.join(F.broadcast(texts), "issue_type").select(
        "position", "issue_type", "column", "severity", "metric", "value", affected.alias("affected"),
        F.concat("column", F.lit(": "), affected.cast("string"), F.lit(" "), "_unit").alias("detail"), "suggestion",
    )


def audit_metrics(df: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """Q15's summary: rows, columns, issues, duplicate rows, and the rows that
    Q16 lists."""
    issues = quality_issues(df) if issues is None else issues
    real = F.col("issue_type") != "no_issue"
    found = issues.agg(
        F.count_if(real).alias("issue_count"),
        F.coalesce(F.max(F.when(F.col("issue_type") == "duplicate_rows", F.col("affected"))), F.lit(0)).alias("duplicate_count"),
    )
    rows = df.agg(F.count(F.lit(1)).alias("row_count"), F.lit(len(df.columns)).alias("column_count"))
    listed = quality_detail_rows(df, []).agg(F.count(F.lit(1)).alias("detail_row_count"))
    return rows.crossJoin(found).crossJoin(listed)  # one row each


def quality_detail_rows(df: DataFrame, key: list[str], per_issue: int | None = None) -> DataFrame:
    """Q16: the whole rows of every row-level issue, in issue order and by
    ``key``: all, or the first ``per_issue`` of each.  Repeated rows are found
    by fingerprint and compared where fingerprints meet, repeated keys by a join
    with the keys that occur more than once."""
    cols = df.columns
    flagged, tcol = _with_future_flag(df)
    named: list[tuple[str, Column]] = []
    again = repeated_rows(df)
    again = again.select(*[F.col(p).alias(f"{p}_b") for p in PRINT], *[F.col(c).alias(f"_r{i}") for i, c in enumerate(cols)], F.lit(True).alias("_dup_row"))
    flagged = flagged.select("*", *fingerprint(cols))
    flagged = flagged.join(again, same_row(flagged, again, cols, [f"_r{i}" for i in range(len(cols))]), "left")
    flagged = flagged.drop(*PRINT, *[f"{p}_b" for p in PRINT], *[f"_r{i}" for i in range(len(cols))])
    named.append(("duplicate_rows", F.coalesce(F.col("_dup_row"), F.lit(False))))
    for j, k in enumerate(business_keys(df)):
        g = df.groupBy(*k).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*[F.col(c).alias(f"_k{j}_{c}") for c in k], F.lit(True).alias(f"_dk{j}"))
        flagged = flagged.join(g, [flagged[c].eqNullSafe(g[f"_k{j}_{c}"]) for c in k], "left").drop(*[f"_k{j}_{c}" for c in k])
        named.append(("duplicate_key", F.coalesce(F.col(f"_dk{j}"), F.lit(False))))
    if tcol:
        named.append(("future_period", F.col("_future")))
    named += [(it, F.coalesce(pred, F.lit(False))) for it, _, _, _, pred in _row_rules(df)]
    tags = F.array(*[F.when(pred, F.struct(F.lit(i).alias("p"), F.lit(name).alias("issue_type"))) for i, (name, pred) in enumerate(named)])
    exploded = flagged.select(*cols, F.explode(F.filter(tags, lambda x: x.isNotNull())).alias("_t"))
    if per_issue is not None:
        exploded = exploded.withColumn("_rn", F.row_number().over(W.partitionBy("_t.p").orderBy(*key))).where(F.col("_rn") <= per_issue)
    out = exploded.orderBy("_t.p", *key) if key else exploded
    return out.select(F.col("_t.p").alias("issue_position"), F.col("_t.issue_type").alias("issue_type"), *cols)


def severity_summary(issues: DataFrame) -> DataFrame:
    """Q17: issue total, high, warning, duplicate rows, first issue."""
    real = F.col("issue_type") != "no_issue"
    return issues.agg(
        F.count_if(real).alias("issue_count"),
        F.count_if(F.col("severity") == "high").alias("high_count"),
        F.count_if(F.col("severity") == "warning").alias("warning_count"),
        F.coalesce(F.max(F.when(F.col("issue_type") == "duplicate_rows", F.col("value"))), F.lit(0.0)).alias("duplicate_rows"),
        F.min_by("issue_type", "position").alias("first_issue"),
    )
