"""Role-bearing views over the driver tables (FIXTURES.md §C).

Each builder returns a lazy DataFrame.  The joins are plain equi-joins without
hints: Spark broadcasts a side only when its estimated size is under
``spark.sql.autoBroadcastJoinThreshold`` and falls back to a sort-merge join
beyond it, and AQE re-plans on runtime sizes.  The SQL twins used by the oracle
are in :mod:`quarry.plans.view_sql`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources.tables import Tables


def _d(x: float) -> Column:
    return F.lit(x).cast("double")


def v_sales(t: Tables) -> DataFrame:
    l, o, c, n, p = t.lineitem, t.orders, t.customer, t.nation, t.part
    j = (
        l.join(o, l.l_orderkey == o.o_orderkey)
        .join(c, o.o_custkey == c.c_custkey)
        .join(n, c.c_nationkey == n.n_nationkey)
        .join(p, l.l_partkey == p.p_partkey)
    )
    sales = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    cost = F.col("l_extendedprice") * _d(0.93)
    return j.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        F.col("n_name").alias("city"),
        F.col("p_brand").alias("category"),
        F.col("p_name").alias("product"),
        F.when(F.col("o_orderstatus") == "F", "completed")
        .when(F.col("o_orderstatus") == "O", "cancelled")
        .otherwise("returned")
        .alias("status"),
        F.col("l_quantity").alias("quantity"),
        F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")).alias("unit_price"),
        F.col("l_discount").alias("discount_rate"),
        sales.alias("sales"),
        cost.alias("cost"),
        (sales - cost).alias("profit"),
        F.try_divide(sales - cost, sales).alias("profit_rate"),
        F.col("o_orderpriority").alias("payment_method"),
        F.col("c_mktsegment").alias("channel"),
    )


def v_subs(t: Tables) -> DataFrame:
    o, c, n = t.orders, t.customer, t.nation
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    k, ck = F.col("o_orderkey"), F.col("o_custkey")
    return j.select(
        k.alias("row_key"),
        ck.alias("customer_id"),
        F.col("c_name").alias("company"),
        F.trunc(F.col("o_orderdate"), "month").alias("month"),
        F.col("o_totalprice").alias("mrr"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "high")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "medium")
        .otherwise("low")
        .alias("renewal_risk"),
        F.col("n_name").alias("manager"),
        F.when(F.col("o_orderstatus") == "F", "paid")
        .when(F.col("o_orderstatus") == "O", "overdue")
        .otherwise("failed")
        .alias("payment_status"),
        F.col("o_totalprice").alias("invoice_amount"),
        (k % 90).cast("int").alias("overdue_days"),
        F.concat(F.lit("channel_"), (ck % 5).cast("string")).alias("channel"),
        F.col("c_mktsegment").alias("industry"),
        F.when(F.col("c_acctbal") < 2000, "SMB").when(F.col("c_acctbal") < 6000, "Mid").otherwise("Enterprise").alias("segment"),
        F.concat(F.lit("plan_"), (ck % 3).cast("string")).alias("plan"),
        F.when(k % 11 == 0, "yes").otherwise("no").alias("churn"),
        F.when(k % 13 == 0, F.lit(None).cast("double")).otherwise((k % 11).cast("double")).alias("nps"),
        F.when(k % 17 == 0, F.lit(None).cast("double")).otherwise(1 + (k % 41) / F.lit(10).cast("double")).alias("csat"),
        (k % 300).cast("double").alias("usage_hours"),
        (ck % 97).cast("double").alias("active_users"),
        (k % 9).cast("double").alias("tickets"),
        (k % 4).cast("double").alias("sla_breaches"),
    )


def v_pipe(t: Tables) -> DataFrame:
    o, c, n = t.orders, t.customer, t.nation
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.select(
        F.col("o_orderkey").alias("deal_id"),
        F.col("o_totalprice").alias("amount"),
        (F.col("o_orderkey") % 101).cast("double").alias("win_rate"),
        F.when(F.col("o_orderstatus") == "F", "closed won")
        .when(F.col("o_orderstatus") == "O", "negotiation")
        .otherwise("lost")
        .alias("stage"),
        F.col("n_name").alias("owner"),
        F.col("o_orderpriority").alias("deal_type"),
    )


def v_log(t: Tables) -> DataFrame:
    e = t.events
    et = F.col("event_type")
    return e.select(
        F.col("event_id").alias("sequence_id"),
        F.col("user_id").alias("task_id"),
        F.col("ts"),
        F.when(et == "signup", "task_started")
        .when(et == "purchase", "task_completed")
        .when(et == "error", "task_failed")
        .otherwise("node_completed")
        .alias("event_type"),
        F.when(et == "purchase", "succeeded").when(et == "error", "failed").otherwise("running").alias("status"),
        et.alias("node"),
        F.col("value"),
        F.col("props").alias("payload"),
        F.concat(F.lit("tenant_"), (F.col("user_id") % 7).cast("string")).alias("tenant_id"),
    )


def v_tok(t: Tables) -> DataFrame:
    e = t.events
    return e.select(
        F.col("event_id").alias("usage_id"),
        F.col("user_id").alias("task_id"),
        F.col("ts").alias("created_at"),
        F.floor(F.col("value")).cast("bigint").alias("prompt_tokens"),
        (F.col("event_id") % 50).cast("bigint").alias("completion_tokens"),
        F.when(F.col("event_type") == "view", "estimated").otherwise("provider").alias("source"),
        F.length(F.col("props")).cast("bigint").alias("output_bytes"),
    )


def v_q(t: Tables) -> DataFrame:
    o, c, n = t.orders, t.customer, t.nation
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    sel = (F.col("o_orderkey") % 8).cast("int")
    question = (
        F.when(sel == 0, F.concat(F.lit("total sum by "), F.col("o_orderpriority"), F.lit(" 2025-"), F.month("o_orderdate").cast("string")))
        .when(sel == 1, F.concat(F.lit("Predict next month for "), F.col("n_name")))
        .when(sel == 2, F.concat(F.lit("top customer name in "), F.col("n_name")))
        .when(sel == 3, F.lit("Does price cause churn?"))
        .when(
            sel == 4,
            F.concat(F.lit("数据质量有哪些明显问题？"), F.col("n_name"), F.lit("的总金额；"), F.year("o_orderdate").cast("string"), F.lit("年3月趋势")),
        )
        .when(sel == 5, F.lit("hello"))
        .when(sel == 6, F.lit("correlation of price and quantity"))
        .otherwise(F.concat(F.lit("count orders by status in "), F.col("n_name")))
    )
    return j.select(F.col("o_orderkey").alias("q_id"), question.alias("question"))


def v_ask(t: Tables) -> DataFrame:
    """One business question an order: every template, role and place rule of
    R4, R5, R10-R13 meets questions that it takes and questions that it does not."""
    o, c, n, r = t.orders, t.customer, t.nation, t.region
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    nation, region = F.col("n_name"), F.col("r_name")
    year, month = F.year("o_orderdate").cast("string"), F.month("o_orderdate")
    asks = [
        F.concat(nation, F.lit("的续约和账款逾期风险怎样联动")),
        F.lit("各客户分层和套餐的MRR"),
        F.concat(F.lit("客户成功应优先处理哪些高风险客户，"), region),
        F.concat(nation, F.lit("的获客渠道投放贡献复盘")),
        F.concat(F.lit("哪些行业适合重点拓展，"), region, F.lit("市场")),
        F.concat(year, F.lit("年"), month.cast("string"), F.lit("月和"), (13 - month).cast("string"), F.lit("月MRR扩张收缩对比")),
        F.lit("NPS、CSAT和工单与风险有什么关系"),
        F.concat(F.lit("已完成订单经营总览，"), year, F.lit("-"), month.cast("string"), F.lit("，满意度")),
        F.concat(F.lit("订单状态对销售额的影响；利润最高的商品名称是什么，"), nation),
        F.lit("主要利润的集中度 Pareto"),
        F.lit("折扣与利润率的关系"),
        F.lit("支付方式的结构占比"),
        F.lit("销售渠道的退货率和复购率，流失率"),
        F.lit("pipeline 商机总金额按负责人排序"),
        F.concat(F.lit("top product name by c_acctbal in "), region),
        F.concat(F.lit("monthly trend of c_acctbal in "), nation, F.lit(" "), year, F.lit("/"), month.cast("string")),
    ]
    which = F.col("o_orderkey") % len(asks)
    question = reduce(lambda done, i: done.when(which == i, asks[i]), range(1, len(asks)), F.when(which == 0, asks[0]))
    return j.select(F.col("o_orderkey").alias("q_id"), question.alias("question"))


def v_dirty(t: Tables) -> DataFrame:
    o = t.orders
    k = F.col("o_orderkey")
    base = o.select(
        k.alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.trunc(F.col("o_orderdate"), "month").alias("month"),
        F.when(k % 4 == 0, F.lit(None).cast("string")).otherwise(F.col("o_orderpriority")).alias("priority"),
        F.when(k % 29 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).alias("mrr"),
        (1 + k % 10).cast("double").alias("quantity"),
        (5 + k % 20).cast("double").alias("unit_price"),
        F.when(k % 31 == 0, _d(70)).when(k % 7 == 0, F.lit(None).cast("double")).otherwise(_d(0.1)).alias("discount_rate"),
        F.lit("EUR").alias("currency"),
        F.concat(F.lit("ref-"), k.cast("string")).alias("reference"),
    )
    q, u, d = F.col("quantity"), F.col("unit_price"), F.col("discount_rate")
    oid = F.col("order_id")
    norm_disc = F.coalesce(F.when(d <= 1, d).otherwise(d / 100), F.lit(0)).cast("double")
    priced = base.withColumn(
        "sales",
        F.when(oid % 37 == 0, _d(0)).when(oid % 41 == 0, q * u + 1).otherwise(q * u * (1 - norm_disc)),
    ).withColumn("cost", q * u * _d(0.6))
    s, c = F.col("sales"), F.col("cost")
    full = priced.withColumn("profit", F.when(oid % 43 == 0, s - c + 5).otherwise(s - c)).withColumn(
        "profit_rate",
        F.when(oid % 47 == 0, _d(0.99)).when(s == 0, F.lit(None).cast("double")).otherwise(F.try_divide(s - c, s)),
    )
    return full.unionByName(full.filter(oid % 53 == 0))


VIEWS = {
    "v_sales": v_sales,
    "v_subs": v_subs,
    "v_pipe": v_pipe,
    "v_log": v_log,
    "v_tok": v_tok,
    "v_q": v_q,
    "v_ask": v_ask,
    "v_dirty": v_dirty,
}


class Views(Tables):
    """Driver tables plus the derived views as lazy attributes."""

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return VIEWS[name](self)
        return super().__getattr__(name)
