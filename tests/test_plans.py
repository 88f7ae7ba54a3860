"""Plan-shape and metamorphic checks."""

import contextlib
import io as _io

from pyspark.sql import functions as F

from quarry.functions.quantiles import grouped_quantiles
from quarry.functions.sequential import keyed_lag
from quarry.operators import analysis as A
from quarry.operators import scope as S
from quarry.operators import templates as T
from quarry.plans.rank import global_row_number
from quarry.sources.views import Views

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    buf = _io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_filter_pushdown_and_pruning(spark):
    o = Views(spark, SF).orders
    p = plan(S.equality_filter(o, ["o_orderstatus=F"]).select("o_orderkey"))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in p


def test_no_python_in_sql_operators(spark):
    v = Views(spark, SF)
    for df in [T.order_status_impact(v.v_sales), A.describe(v.lineitem), T.health_signal_correlations(v.v_subs)]:
        p = plan(df)
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_global_rank_avoids_single_partition(spark):
    v = Views(spark, SF)
    p = plan(global_row_number(v.orders, [F.col("o_totalprice").desc(), F.col("o_orderkey")], "r"))
    assert "rangepartitioning" in p.lower()
    ranked = global_row_number(v.orders, [F.col("o_totalprice").desc(), F.col("o_orderkey")], "r")
    from pyspark.sql import Window as W

    ref = v.orders.withColumn("r2", F.row_number().over(W.orderBy(F.col("o_totalprice").desc(), F.col("o_orderkey"))))
    assert ranked.join(ref, "o_orderkey").where("r <> r2").count() == 0


def test_quantiles_match_percentile(spark):
    o = Views(spark, SF).orders
    q = {r["o_orderpriority"]: r["q50"] for r in grouped_quantiles(o, ["o_orderpriority"], "o_totalprice", [0.5]).collect()}
    ref = {r[0]: r[1] for r in o.groupBy("o_orderpriority").agg(F.percentile("o_totalprice", 0.5)).collect()}
    assert q.keys() == ref.keys() and all(abs(q[k] - ref[k]) < 1e-6 for k in q)


def test_keyed_lag_on_a_hot_key(spark):
    # one key holds most rows: the lag must still equal the window lag
    df = spark.range(0, 3000).select(F.when(F.col("id") % 10 < 8, 1).otherwise(F.col("id") % 7).alias("k"), F.col("id").alias("s"), (F.col("id") * 3).alias("v"))
    got = keyed_lag(df, ["k"], ["s"], ["v"], partitions=16)
    from pyspark.sql import Window as W

    ref = df.withColumn("pv", F.lag("v").over(W.partitionBy("k").orderBy("s")))
    assert got.join(ref, ["k", "s"]).where(~F.col("prev_v").eqNullSafe(F.col("pv"))).count() == 0


def test_repartition_invariance(spark):
    v = Views(spark, SF)
    a = sorted(map(tuple, T.order_status_impact(v.v_sales).collect()))
    b = sorted(map(tuple, T.order_status_impact(v.v_sales.repartition(13)).collect()))
    assert a == b


def test_group_sum_equals_total(spark):
    v = Views(spark, SF)
    parts = sum(r["sales"] for r in T.order_status_impact(v.v_sales).collect())
    total = T.sales_overview_status(v.v_sales).first()["sales"]
    assert abs(parts - total) < 0.05


def test_hot_key_running_sum_and_quantiles(spark):
    from pyspark.sql import Window as W

    from quarry.functions.sequential import keyed_running_sum

    df = spark.range(0, 5000).select(
        F.when(F.col("id") % 10 < 7, 1).otherwise(F.col("id") % 5).alias("k"), F.col("id").alias("s"), ((F.col("id") * 7) % 13).alias("v")
    )
    got = keyed_running_sum(df, ["k"], ["s"], "v", "rs", partitions=16)
    ref = df.withColumn("rs2", F.sum("v").over(W.partitionBy("k").orderBy("s").rowsBetween(W.unboundedPreceding, 0)))
    assert got.join(ref, ["k", "s"]).where(F.col("rs") != F.col("rs2")).count() == 0
    q = {r["k"]: (r["q25"], r["q50"]) for r in grouped_quantiles(df, ["k"], "v", [0.25, 0.5]).collect()}
    exp = {r[0]: (r[1], r[2]) for r in df.groupBy("k").agg(F.percentile("v", 0.25), F.percentile("v", 0.5)).collect()}
    assert q.keys() == exp.keys() and all(abs(q[k][i] - exp[k][i]) < 1e-9 for k in q for i in (0, 1))
