"""Subscription-revenue and sales business templates.

Every template is one grouped or conditional aggregate over the input (plus,
where the reference scopes by the latest complete month, a one-row F5 table
joined back with a broadcast).  Per-group Python (the reference's
``groupby.apply`` and row lambdas) becomes conditional aggregates.  Rank
numbers over an unbounded grouped table use :func:`quarry.plans.rank.global_row_number`,
which never routes the whole table through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from quarry.functions.columns import (
    guarded_corr,
    latest_complete_period,
    latest_from_counts,
    month_label,
    num,
    num0,
    percent_normalise,
    role,
    text_mask,
)
from quarry.operators.scope import ALL_PERIODS_LABEL, last_period, parse_period, scope_month_or_all, scope_month_or_latest, start_end_periods, with_period
from quarry.plans.rank import global_row_number


def _count_distinct_or_rows(customer: str | None, cond: Column | None = None) -> Column:
    if customer:
        x = F.col(customer) if cond is None else F.when(cond, F.col(customer))
        return F.count_distinct(x)
    return F.count(F.lit(1)) if cond is None else F.count_if(cond)


def _stack(agg_row: DataFrame, rows: list[tuple[Column, ...]], names: list[str]) -> DataFrame:
    """Turn one aggregate row into several output rows (a ``stack``)."""
    structs = [F.struct(*[v.alias(n) for v, n in zip(r, names)]) for r in rows]
    return agg_row.select(F.explode(F.array(*structs)).alias("_r")).select("_r.*")


# ---------------------------------------------------------------- T1 -------
def payment_renewal_summary(df: DataFrame, period: str | None = None, month: int | None = None, **roles) -> DataFrame:
    """Six measures of problem invoices and high-risk MRR in ONE pass of
    conditional aggregates, stacked to rows.

    As in the reference, the scope month of problem rows is F5 of the problem
    rows, while the high-risk-MRR row uses F5 of all rows; both come from one
    monthly count table and each row carries its own ``scope`` label."""
    pay = role(df, "payment_status", roles.get("payment"), required=True)
    inv = role(df, "invoice", roles.get("invoice"), required=True)
    overdue = role(df, "overdue_days", roles.get("overdue"))
    risk = role(df, "risk", roles.get("risk"))
    mrr = role(df, "mrr", roles.get("mrr"))
    time_col = role(df, "time", roles.get("time"))
    cust = role(df, "customer", roles.get("customer"))

    w = with_period(df, time_col).withColumn("_issue", text_mask(pay, "payment_issue"))
    p = F.col("_period")
    period = last_period(period)
    explicit = parse_period(period) if period else None
    if explicit:
        s_issue = s_all = p == F.lit(explicit).cast("date")
        lab_issue = lab_all = F.lit(explicit[:7])
        scoped = w
    elif month and 1 <= int(month) <= 12:
        s_issue = s_all = F.month(p) == int(month)
        lab_issue = lab_all = F.lit(f"{int(month)} 月")
        scoped = w
    else:
        counts = w.where(p.isNotNull()).groupBy("_period").agg(F.count_if("_issue").alias("_ni"), F.count(F.lit(1)).alias("_na"))
        latest = latest_from_counts(counts, "_period", "_ni", "_li").crossJoin(latest_from_counts(counts, "_period", "_na", "_la"))
        scoped = w.crossJoin(F.broadcast(latest))
        s_issue = F.col("_li").isNull() | (p == F.col("_li"))
        s_all = F.col("_la").isNull() | (p == F.col("_la"))
        lab_issue = F.coalesce(month_label(F.col("_li")), F.lit(ALL_PERIODS_LABEL))
        lab_all = F.coalesce(month_label(F.col("_la")), F.lit(ALL_PERIODS_LABEL))
    issue = F.col("_issue")
    high = text_mask(risk, "high_risk") if risk else F.lit(False)
    med_high = text_mask(risk, "medium_high") if risk else F.lit(False)
    amount, mrr_v = num0(inv), (num0(mrr) if mrr else F.lit(0.0))
    measures = [("problem_invoices", F.lit(ALL_PERIODS_LABEL), issue, amount), ("problem_invoices_in_scope", lab_issue, issue & s_issue, amount)]
    if overdue:
        measures.append(("overdue_45_days", F.lit(ALL_PERIODS_LABEL), issue & (num0(overdue) >= 45), amount))
    if risk:
        measures.append(("high_risk_problem", lab_issue, issue & s_issue & high, amount))
        measures.append(("high_medium_risk_problem", lab_issue, issue & s_issue & med_high, amount))
    if mrr and risk:
        measures.append(("high_risk_mrr", lab_all, s_all & high, mrr_v))
    # per customer first, then over customers: distinct counts without a row
    # copy for every measure
    per, aggs = [], []
    for i, (_, label, cond, value) in enumerate(measures):
        per += [F.first(label).alias(f"l{i}"), F.count_if(cond).alias(f"r{i}"), F.sum(F.when(cond, value)).alias(f"a{i}")]
        hit = (F.col(f"r{i}") > 0) & F.col("_cust").isNotNull()
        aggs += [
            F.first(f"l{i}", ignorenulls=True).alias(f"l{i}"),
            F.coalesce(F.sum(f"r{i}"), F.lit(0)).alias(f"r{i}"),
            (F.count_if(hit) if cust else F.coalesce(F.sum(f"r{i}"), F.lit(0))).alias(f"c{i}"),
            F.round(F.coalesce(F.sum(f"a{i}"), F.lit(0.0)), 2).alias(f"a{i}"),
        ]
    scoped = scoped.groupBy((F.col(cust) if cust else F.lit(0)).alias("_cust")).agg(*per)
    rows = [
        (F.coalesce(F.col(f"l{i}"), F.lit(ALL_PERIODS_LABEL)), F.lit(name), F.col(f"r{i}"), F.col(f"c{i}"), F.col(f"a{i}"))
        for i, (name, _, _, _) in enumerate(measures)
    ]
    return _stack(scoped.agg(*aggs), rows, ["scope", "measure", "records", "customers", "amount"])


def collection_priority(df: DataFrame, period: str | None = None, month: int | None = None, n: int = 20, **roles) -> DataFrame:
    """Scoped problem invoices by amount, overdue days (desc); top n."""
    pay = role(df, "payment_status", roles.get("payment"), required=True)
    inv = role(df, "invoice", roles.get("invoice"), required=True)
    overdue = role(df, "overdue_days", roles.get("overdue"))
    time_col = role(df, "time", roles.get("time"))
    key = roles.get("key") or role(df, "customer")
    issue = df.where(text_mask(pay, "payment_issue"))
    scoped = scope_month_or_latest(issue, time_col, period, month)
    keep = [c for c in [role(df, "customer"), role(df, "company"), role(df, "manager"), pay, role(df, "risk"), inv, overdue, role(df, "mrr"), time_col] if c]
    keep = list(dict.fromkeys(keep))
    order = [num0(inv).desc()] + ([num0(overdue).desc()] if overdue else []) + [F.col(c).asc_nulls_last() for c in keep if c != inv]
    if key and key not in keep:
        order.append(F.col(key))
    out = scoped.orderBy(*order).limit(n).select(*keep)
    rounded = [F.round(num0(c), 2).alias(c) if c in (inv, role(df, "mrr")) else F.col(c) for c in keep]
    return out.select(*rounded)


# ---------------------------------------------------------------- T2 -------
def customer_success_priority(df: DataFrame, period: str | None = None, month: int | None = None, **roles) -> DataFrame:
    """Per manager in scope, ordered by high-risk MRR, problem amount, MRR."""
    mgr = role(df, "cs_manager", roles.get("manager"), required=True)
    mrr = role(df, "mrr", roles.get("mrr"), required=True)
    risk = role(df, "risk", roles.get("risk"))
    cust = role(df, "customer", roles.get("customer"))
    time_col = role(df, "time", roles.get("time"))
    pay = role(df, "payment_status", roles.get("payment"))
    inv = role(df, "invoice", roles.get("invoice"))
    w = scope_month_or_latest(df, time_col, period, month)
    high = text_mask(risk, "high_risk") if risk else F.lit(False)
    mh = text_mask(risk, "medium_high") if risk else F.lit(False)
    problem = F.when(text_mask(pay, "payment_issue"), num0(inv)).otherwise(0.0) if pay and inv else F.lit(0.0)
    g = w.groupBy(mgr).agg(
        _count_distinct_or_rows(cust).alias("customers"),
        F.round(F.sum(num0(mrr)), 2).alias("total_mrr"),
        _count_distinct_or_rows(cust, high).alias("high_risk_customers"),
        F.round(F.coalesce(F.sum(F.when(high, num0(mrr))), F.lit(0.0)), 2).alias("high_risk_mrr"),
        F.round(F.coalesce(F.sum(F.when(mh, num0(mrr))), F.lit(0.0)), 2).alias("high_medium_risk_mrr"),
        F.round(F.sum(problem), 2).alias("problem_invoice_amount"),
    )
    order = [F.col("high_risk_mrr").desc(), F.col("problem_invoice_amount").desc(), F.col("total_mrr").desc(), F.col(mgr).asc_nulls_last()]
    return global_row_number(g, order, "priority")


# ---------------------------------------------------------------- T3-T6 ----
def _risk_frame(df: DataFrame, period: str | None, month: int | None, roles: dict) -> tuple[DataFrame, list[Column]]:
    """Scoped rows and the aggregate list shared by T3–T6."""
    metric = role(df, "metric", roles.get("metric"))
    if metric is None:
        metric = next(f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "long", "integer", "float", "decimal"))
    cust = role(df, "customer", roles.get("customer"))
    time_col = role(df, "time", roles.get("time"))
    risk = role(df, "risk", roles.get("risk"))
    churn = role(df, "churn", roles.get("churn"))
    nps = role(df, "nps", roles.get("nps"))
    w = scope_month_or_all(df, time_col, period, month)
    high = text_mask(risk, "high_risk") if risk else F.lit(False)
    ch = text_mask(churn, "yes") if churn else F.lit(False)
    aggs = [
        F.count(F.lit(1)).alias("records"),
        _count_distinct_or_rows(cust).alias("customers"),
        F.round(F.sum(num0(metric)), 2).alias("metric_sum"),
        F.round(F.avg(num0(metric)), 2).alias("metric_mean"),
        F.count_if(high).alias("high_risk_records"),
        F.count_if(ch).alias("churn_records"),
    ]
    if nps:
        aggs.append(F.round(F.avg(num0(nps)), 2).alias("avg_nps"))
    return w, aggs


def _with_rates(g: DataFrame) -> DataFrame:
    g = g.withColumn("high_risk_rate", F.round(F.coalesce(F.try_divide(F.col("high_risk_records"), F.col("records")), F.lit(0.0)), 4))
    return g.withColumn("churn_rate", F.round(F.coalesce(F.try_divide(F.col("churn_records"), F.col("records")), F.lit(0.0)), 4))


def dimension_risk(df: DataFrame, dimension: str, period: str | None = None, month: int | None = None, **roles) -> DataFrame:
    """Per dimension value (nulls kept), default all rows."""
    w, aggs = _risk_frame(df, period, month, roles)
    g = _with_rates(w.groupBy(dimension).agg(*aggs))
    return g.orderBy(F.col("metric_sum").desc_nulls_last(), F.col("high_risk_rate").desc(), F.col(dimension).asc_nulls_last())


def channel_performance_risk(df: DataFrame, **kw) -> DataFrame:
    """T4: T3 by acquisition channel."""
    return dimension_risk(df, role(df, "channel", kw.pop("channel", None), required=True), **kw)


def industry_market_selection(df: DataFrame, **kw) -> DataFrame:
    """T5: T3 by industry."""
    return dimension_risk(df, role(df, "industry", kw.pop("industry", None), required=True), **kw)


def segment_plan_strategy(df: DataFrame, period: str | None = None, month: int | None = None, **roles) -> DataFrame:
    """T3 by segment and by plan in ONE pass with GROUPING SETS; stacked as
    (dimension_type, dimension_value).  ``grouping()`` tells a set's own null
    key apart from the other set's rolled-up column."""
    dims = [d for d in (role(df, "segment", roles.pop("segment", None)), role(df, "plan", roles.pop("plan", None))) if d]
    if not dims:
        raise ValueError("segment_plan_strategy needs a segment or plan column")
    w, aggs = _risk_frame(df, period, month, roles)
    flags = [F.grouping(d).alias(f"_g{i}") for i, d in enumerate(dims)]
    g = w.groupingSets([[d] for d in dims], *dims).agg(*aggs, *flags)
    dtype, dval = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, d in enumerate(reversed(dims)):
        j = len(dims) - 1 - i
        dtype = F.when(F.col(f"_g{j}") == 0, F.lit(d)).otherwise(dtype)
        dval = F.when(F.col(f"_g{j}") == 0, F.col(d).cast("string")).otherwise(dval)
    out = g.select(dtype.alias("dimension_type"), dval.alias("dimension_value"), *[a for a in g.columns if a not in dims and not a.startswith("_g")])
    g = _with_rates(out)
    first = F.when(F.col("dimension_type") == dims[0], 0).otherwise(1)
    return g.orderBy(first, F.col("metric_sum").desc_nulls_last(), F.col("high_risk_rate").desc(), F.col("dimension_value").asc_nulls_last())


# ---------------------------------------------------------------- T7 -------
def expansion_panel(df: DataFrame, start: str | None = None, end: str | None = None, periods: list[str] | None = None, **roles) -> DataFrame:
    """Customers present in the first and the last month, with delta.

    First month = explicit start or min month; last = explicit end or F5.
    Duplicate rows of a customer in a month keep the one with the smallest
    ``order_key`` (the reference keeps file order, which Spark does not have).
    """
    cust = role(df, "customer", roles.get("customer"), required=True)
    mrr = role(df, "mrr", roles.get("mrr"), required=True)
    time_col = role(df, "time", roles.get("time"), required=True)
    company = role(df, "company", roles.get("company"))
    order_key = roles.get("order_key") or cust
    w = with_period(df, time_col).where(F.col("_period").isNotNull()).withColumn("_mrr", num0(mrr))
    s, e = start_end_periods(periods or [], start, end)
    bounds = w.agg(F.min("_period").alias("_min"))
    bounds = bounds.crossJoin(latest_complete_period(w, "_period"))
    bounds = bounds.select(
        (F.lit(s).cast("date") if s else F.col("_min")).alias("first_period"),
        (F.lit(e).cast("date") if e else F.col("latest_period")).alias("last_period"),
    )
    wb = w.crossJoin(F.broadcast(bounds))

    def one_per_customer(cond: Column, value_name: str, extra: list[str]) -> DataFrame:
        part = wb.where(cond)
        picked = part.groupBy(cust).agg(F.min_by(F.struct(F.col("_mrr").alias("v"), *[F.col(x) for x in extra]), F.struct(F.col(order_key), F.col("_mrr"))).alias("_s"))
        return picked.select(cust, F.col("_s.v").alias(value_name), *[F.col(f"_s.{x}").alias(x) for x in extra])

    first = one_per_customer(F.col("_period") == F.col("first_period"), "mrr_first", [company] if company else [])
    last = one_per_customer(F.col("_period") == F.col("last_period"), "mrr_last", [])
    panel = first.join(last, cust, "inner")
    delta = F.col("mrr_last") - F.col("mrr_first")
    return panel.withColumn("mrr_change", delta).withColumn(
        "change_type", F.when(delta > 0, "expansion").when(delta < 0, "contraction").otherwise("flat")
    ).crossJoin(F.broadcast(bounds.select(month_label(F.col("first_period")).alias("first_month"), month_label(F.col("last_period")).alias("last_month"))))


def expansion_summary(panel: DataFrame) -> DataFrame:
    """Expansion / contraction / net rows from a T7a panel."""
    d = F.col("mrr_change")
    agg = panel.agg(
        F.count_if(d > 0).alias("n_up"),
        F.round(F.coalesce(F.sum(F.when(d > 0, d)), F.lit(0.0)), 2).alias("s_up"),
        F.count_if(d < 0).alias("n_down"),
        F.round(F.coalesce(F.sum(F.when(d < 0, d)), F.lit(0.0)), 2).alias("s_down"),
        F.count(F.lit(1)).alias("n_all"),
        F.round(F.coalesce(F.sum(d), F.lit(0.0)), 2).alias("s_all"),
    )
    rows = [
        (F.lit("expansion"), F.col("n_up"), F.col("s_up")),
        (F.lit("contraction"), F.col("n_down"), F.col("s_down")),
        (F.lit("net"), F.col("n_all"), F.col("s_all")),
    ]
    return _stack(agg, rows, ["type", "customers", "mrr_change"])


def top_movers(panel: DataFrame, customer: str, n: int = 20) -> DataFrame:
    """Top n expansions and top n contractions, stacked."""
    up = panel.where(F.col("mrr_change") > 0).orderBy(F.col("mrr_change").desc(), F.col(customer)).limit(n)
    down = panel.where(F.col("mrr_change") < 0).orderBy(F.col("mrr_change").asc(), F.col(customer)).limit(n)
    return up.withColumn("direction", F.lit("expansion")).unionByName(down.withColumn("direction", F.lit("contraction")))


# ---------------------------------------------------------------- T8 -------
def health_signal_correlations(df: DataFrame, **roles) -> DataFrame:
    """The seven named health pairs, pairwise-complete, n ≥ 3, r to 4 dp,
    computed in ONE aggregate; ordered by |r| desc.  If no named pair has a
    correlation, all pairs of numeric columns take their place."""
    cols = df.columns
    usage = role(df, "usage", roles.get("usage"))
    active = role(df, "active", roles.get("active"))
    tickets = role(df, "tickets", roles.get("tickets"))
    sla = role(df, "sla", roles.get("sla"))
    nps = role(df, "nps", roles.get("nps"))
    csat = role(df, "csat", roles.get("csat"))
    mrr = role(df, "mrr", roles.get("mrr"))
    risk = role(df, "risk", roles.get("risk"))
    risk_code = (
        F.when(F.col(risk).cast("string").contains("高"), 3.0)
        .when(F.col(risk).cast("string").contains("中"), 2.0)
        .when(F.col(risk).cast("string").contains("低"), 1.0)
        .when(F.lower(F.col(risk).cast("string")).contains("high"), 3.0)
        .when(F.lower(F.col(risk).cast("string")).contains("medium"), 2.0)
        .when(F.lower(F.col(risk).cast("string")).contains("low"), 1.0)
        if risk
        else None
    )
    value = lambda c: num(c) if c in cols else None
    pairs = [
        ("usage vs mrr", usage, mrr),
        ("active users vs mrr", active, mrr),
        ("tickets vs renewal risk", tickets, "__risk__"),
        ("sla breaches vs renewal risk", sla, "__risk__"),
        ("nps vs renewal risk", nps, "__risk__"),
        ("csat vs renewal risk", csat, "__risk__"),
        ("csat vs nps", csat, nps),
    ]
    exprs, rows = [], []
    for i, (label, a, b) in enumerate(pairs):
        if not a or not b or (b == "__risk__" and risk_code is None):
            continue
        ca = value(a)
        cb = risk_code if b == "__risk__" else value(b)
        both = ca.isNotNull() & cb.isNotNull()
        exprs += [guarded_corr(ca, cb).alias(f"r{i}"), F.count_if(both).alias(f"n{i}")]
        rows.append((F.lit(label), F.lit(a), F.lit(risk if b == "__risk__" else b), F.round(F.col(f"r{i}"), 4), F.col(f"n{i}")))
    names = ["relation", "field_a", "field_b", "r", "n"]
    spark, kind = df.sparkSession, "relation string, field_a string, field_b string, r double, n bigint"
    found = None
    if rows:
        # one row a named pair, so the aggregate is run here: whether the other pairs are needed hangs on it
        named = _stack(df.agg(*exprs), rows, names).where((F.col("n") >= 3) & F.col("r").isNotNull()).collect()
        found = spark.createDataFrame([tuple(r) for r in named], kind) if named else None
    numeric = sorted(f.name for f in df.schema.fields if isinstance(f.dataType, NumericType))
    every = [(a, b) for i, a in enumerate(numeric) for b in numeric[i + 1 :]]
    if found is None and every:
        exprs, rows = [], []
        for i, (a, b) in enumerate(every):
            both = num(a).isNotNull() & num(b).isNotNull()
            exprs += [guarded_corr(num(a), num(b)).alias(f"r{i}"), F.count_if(both).alias(f"n{i}")]
            rows.append((F.lit(f"{a} vs {b}"), F.lit(a), F.lit(b), F.round(F.col(f"r{i}"), 4), F.col(f"n{i}")))
        found = _stack(df.agg(*exprs), rows, names).where(F.col("r").isNotNull())
    if found is None:
        return spark.createDataFrame([], kind)
    return found.orderBy(F.abs("r").desc(), "relation")


# ---------------------------------------------------------------- T9-T14 ---
def _by_sales(g: DataFrame, dim: str) -> DataFrame:
    return g.orderBy(F.col("sales").desc_nulls_last(), F.col(dim).asc_nulls_last())


def _with_share(g: DataFrame) -> DataFrame:
    """Share of all sales; the total comes from the grouped rows."""
    total = g.agg(F.greatest(F.sum("_raw"), F.lit(1.0)).alias("_total"))  # one row
    return g.crossJoin(F.broadcast(total)).withColumn("sales_share", F.round(F.col("sales") / F.col("_total"), 4)).drop("_total", "_raw")


def _sales_group(df: DataFrame, dim: str, sales: str, profit: str | None) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("orders"), F.round(F.sum(num0(sales)), 2).alias("sales"), F.sum(num0(sales)).alias("_raw")]
    if profit:
        aggs.append(F.round(F.sum(num0(profit)), 2).alias("profit"))
    g = df.groupBy(dim).agg(*aggs)
    if profit:
        g = g.withColumn("margin", F.round(F.coalesce(F.try_divide(F.col("profit"), F.when(F.col("sales") != 0, F.col("sales"))), F.lit(0.0)), 4))
    return g


def sales_overview_status(df: DataFrame, **roles) -> DataFrame:
    """All orders and completed orders — count, sales, profit, margin, share."""
    sales = role(df, "sales", roles.get("sales"), required=True)
    profit = role(df, "profit", roles.get("profit"), required=True)
    status = role(df, "status", roles.get("status"))
    done = text_mask(status, "completed") if status else F.lit(False)
    agg = df.agg(
        F.count(F.lit(1)).alias("n_all"),
        F.round(F.sum(num0(sales)), 2).alias("s_all"),
        F.round(F.sum(num0(profit)), 2).alias("p_all"),
        F.count_if(done).alias("n_done"),
        F.round(F.coalesce(F.sum(F.when(done, num0(sales))), F.lit(0.0)), 2).alias("s_done"),
        F.round(F.coalesce(F.sum(F.when(done, num0(profit))), F.lit(0.0)), 2).alias("p_done"),
    )

    def margin(p: str, s: str) -> Column:
        return F.round(F.coalesce(F.try_divide(F.col(p), F.when(F.col(s) != 0, F.col(s))), F.lit(0.0)), 4)

    rows = [(F.lit("all_orders"), F.col("n_all"), F.col("s_all"), F.col("p_all"), margin("p_all", "s_all"), F.lit(None).cast("double"))]
    if status:
        share = F.round(F.coalesce(F.try_divide(F.col("s_done"), F.when(F.col("s_all") != 0, F.col("s_all"))), F.lit(0.0)), 4)
        rows.append((F.lit("completed_orders"), F.col("n_done"), F.col("s_done"), F.col("p_done"), margin("p_done", "s_done"), share))
    return _stack(agg, rows, ["scope", "orders", "sales", "profit", "margin", "sales_share"])


def order_status_impact(df: DataFrame, **roles) -> DataFrame:
    """Per status: orders, sales, profit, margin (0 when sales is 0)."""
    status = role(df, "status", roles.get("status"), required=True)
    sales = role(df, "sales", roles.get("sales"), required=True)
    profit = role(df, "profit", roles.get("profit"))
    return _by_sales(_sales_group(df, status, sales, profit).drop("_raw"), status)


def product_pareto(df: DataFrame, n: int = 20, **roles) -> DataFrame:
    """Per product + share of total + cumulative share of rounded shares;
    the first n products by sales.  Only those n rows need the running sum,
    so the window runs on a top-n table (``TakeOrderedAndProject`` first)."""
    product = role(df, "product", roles.get("product"), required=True)
    sales = role(df, "sales", roles.get("sales"), required=True)
    profit = role(df, "profit", roles.get("profit"))
    g = _with_share(_sales_group(df, product, sales, profit))
    top = g.orderBy(F.col("sales").desc(), F.col(product).asc_nulls_last()).limit(n)
    from pyspark.sql import Window as W

    w = W.orderBy(F.col("sales").desc(), F.col(product).asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.currentRow)
    return top.withColumn("cumulative_share", F.round(F.sum("sales_share").over(w), 4))


def discount_profit_by_rate(df: DataFrame, **roles) -> DataFrame:
    """Per raw discount value (nulls kept): orders, mean profit rate."""
    disc = role(df, "discount", roles.get("discount"), required=True)
    pr = role(df, "profit_rate", roles.get("profit_rate"), required=True)
    g = df.groupBy(disc).agg(F.count(F.lit(1)).alias("orders"), F.round(F.avg(num0(pr)), 4).alias("avg_profit_rate"))
    return g.orderBy(F.col(disc).asc_nulls_last())


def discount_profit_corr(df: DataFrame, **roles) -> DataFrame:
    """corr(discount, profit rate), missing values counted as 0."""
    disc = role(df, "discount", roles.get("discount"), required=True)
    pr = role(df, "profit_rate", roles.get("profit_rate"), required=True)
    return df.agg(F.round(guarded_corr(num0(disc), num0(pr)), 4).alias("correlation"), F.count(F.lit(1)).alias("n"))


def discount_anomalies(df: DataFrame, n: int = 20, **roles) -> DataFrame:
    """Negative-profit orders, first n by a deterministic key."""
    disc = role(df, "discount", roles.get("discount"), required=True)
    pr = role(df, "profit_rate", roles.get("profit_rate"), required=True)
    profit = role(df, "profit", roles.get("profit"))
    oid = role(df, "order_id", roles.get("order_id"))
    sales = role(df, "sales", roles.get("sales"))
    keep = list(dict.fromkeys(c for c in [oid, disc, sales, profit, pr] if c))
    rows = df.where(num0(profit) < 0) if profit else df
    order_cols = [F.col(c).asc_nulls_last() for c in (roles.get("order_key") or keep)]
    return rows.select(*keep).orderBy(*order_cols).limit(n)


def payment_mix(df: DataFrame, **roles) -> DataFrame:
    """T10 by payment method + share of total sales."""
    pay = role(df, "pay_method", roles.get("payment"), required=True)
    sales = role(df, "sales", roles.get("sales"), required=True)
    profit = role(df, "profit", roles.get("profit"))
    return _by_sales(_with_share(_sales_group(df, pay, sales, profit)), pay)


def sales_channel_strategy(df: DataFrame, **roles) -> DataFrame:
    """T10 by channel plus cancel/return rates (null channel: no rates,
    as the reference's left join on a dropna group)."""
    ch = role(df, "sales_channel", roles.get("channel"), required=True)
    sales = role(df, "sales", roles.get("sales"), required=True)
    profit = role(df, "profit", roles.get("profit"))
    status = role(df, "status", roles.get("status"))
    aggs = [F.count(F.lit(1)).alias("orders"), F.round(F.sum(num0(sales)), 2).alias("sales")]
    if profit:
        aggs.append(F.round(F.sum(num0(profit)), 2).alias("profit"))
    if status:
        aggs += [F.avg(text_mask(status, "cancelled").cast("double")).alias("_c"), F.avg(text_mask(status, "returned").cast("double")).alias("_r")]
    g = df.groupBy(ch).agg(*aggs)
    if profit:
        g = g.withColumn("margin", F.round(F.coalesce(F.try_divide(F.col("profit"), F.when(F.col("sales") != 0, F.col("sales"))), F.lit(0.0)), 4))
    if status:
        g = g.withColumn("cancel_rate", F.round(F.when(F.col(ch).isNotNull(), F.col("_c")), 4))
        g = g.withColumn("return_rate", F.round(F.when(F.col(ch).isNotNull(), F.col("_r")), 4)).drop("_c", "_r")
    return _by_sales(g, ch)


# ---------------------------------------------------------------- T15 ------
def _pipe_work(df: DataFrame, roles: dict) -> tuple[DataFrame, dict]:
    amount = role(df, "pipe_amount", roles.get("amount"), required=True)
    prob = role(df, "probability", roles.get("probability"), required=True)
    stage = role(df, "stage", roles.get("stage"), required=True)
    owner = role(df, "pipe_owner", roles.get("owner"))
    dtype = role(df, "deal_type", roles.get("type"))
    p = num0(prob)
    w = df.withColumn("_amount", num0(amount)).withColumn("_weighted", F.col("_amount") * percent_normalise(p)).withColumn("_won", text_mask(stage, "won"))
    return w, {"amount": amount, "stage": stage, "owner": owner, "type": dtype}


def pipeline_summary(df: DataFrame, **roles) -> DataFrame:
    """Total pipeline, probability-weighted pipeline, won amount."""
    w, _ = _pipe_work(df, roles)
    agg = w.agg(
        F.round(F.sum("_amount"), 2).alias("t"),
        F.round(F.sum("_weighted"), 2).alias("wt"),
        F.round(F.coalesce(F.sum(F.when(F.col("_won"), F.col("_amount"))), F.lit(0.0)), 2).alias("won"),
    )
    rows = [(F.lit("total_pipeline"), F.col("t")), (F.lit("weighted_pipeline"), F.col("wt")), (F.lit("won_amount"), F.col("won"))]
    return _stack(agg, rows, ["measure", "pipeline_amount"])


def pipeline_by(df: DataFrame, by: str = "stage", **roles) -> DataFrame:
    """T15b/c/d: per owner / stage / type: deals, total, weighted (owner: won)."""
    w, r = _pipe_work(df, roles)
    key = r[by]
    if key is None:
        raise ValueError(f"no {by} column")
    aggs = [
        F.count(F.lit(1)).alias("deals"),
        F.round(F.sum("_amount"), 2).alias("total_pipeline"),
        F.round(F.sum("_weighted"), 2).alias("weighted_pipeline"),
    ]
    if by == "owner":
        aggs.append(F.round(F.sum(F.when(F.col("_won"), F.col("_amount")).otherwise(0.0)), 2).alias("won_amount"))
    return w.groupBy(key).agg(*aggs).orderBy(F.col("total_pipeline").desc_nulls_last(), F.col(key).asc_nulls_last())


def pipeline_breakdown(df: DataFrame, **roles) -> DataFrame:
    """T15b–d in ONE pass: GROUPING SETS over owner, stage and type, stacked
    as (dimension_type, dimension_value); won amount is kept for every set."""
    w, r = _pipe_work(df, roles)
    dims = [r[k] for k in ("owner", "stage", "type") if r[k]]
    flags = [F.grouping(d).alias(f"_g{i}") for i, d in enumerate(dims)]
    g = w.groupingSets([[d] for d in dims], *dims).agg(
        F.count(F.lit(1)).alias("deals"),
        F.round(F.sum("_amount"), 2).alias("total_pipeline"),
        F.round(F.sum("_weighted"), 2).alias("weighted_pipeline"),
        F.round(F.sum(F.when(F.col("_won"), F.col("_amount")).otherwise(0.0)), 2).alias("won_amount"),
        *flags,
    )
    dtype, dval = F.lit(None).cast("string"), F.lit(None).cast("string")
    for j in reversed(range(len(dims))):
        dtype = F.when(F.col(f"_g{j}") == 0, F.lit(dims[j])).otherwise(dtype)
        dval = F.when(F.col(f"_g{j}") == 0, F.col(dims[j]).cast("string")).otherwise(dval)
    return g.select(dtype.alias("dimension_type"), dval.alias("dimension_value"), "deals", "total_pipeline", "weighted_pipeline", "won_amount")
