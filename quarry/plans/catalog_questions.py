"""Registered queries for R1–R13 (and A21) over the v_q question log.

The oracle SQL is generated from the same fixed keyword lists (DuckDB
``contains`` / ``CASE``), so both engines evaluate the rules independently."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import analysis as A
from quarry.operators import profile as P
from quarry.operators import questions as R
from quarry.plans.catalog_profile import CUSTOMER_COLS, _types_sql
from quarry.plans.registry import query
from quarry.sources.views import Views


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any(expr: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, {_lit(w)})" for w in words) + ")"


_Q = "lower(coalesce(question, ''))"


def _triage_sql(col: str) -> str:
    q = f"trim(lower(coalesce({col}, '')))"
    return f"""CASE WHEN {q} = '' THEN 'empty' WHEN {_any(q, R.UNSAFE_TERMS)} THEN 'unsafe_or_prompt_injection'
 WHEN {_any(q, R.PREDICTION_TERMS)} THEN 'prediction_not_supported' WHEN {_any(q, R.CAUSAL_TERMS)} THEN 'causal_not_supported'
 WHEN {_any(q, R.OUT_OF_DOMAIN_TERMS)} THEN 'out_of_domain' WHEN {q} IN ({', '.join(_lit(g) for g in R.GREETINGS)}) THEN 'no_analysis_objective' ELSE 'answerable' END"""


def _goal_sql() -> str:
    g, q = R.GOAL_RULES, _Q
    return f"""CASE WHEN contains({q}, 'mrr') AND {_any(q, g['mrr_words'])} THEN 'mrr_snapshot_vs_cumulative'
 WHEN {_any(q, g['risk_a'])} AND {_any(q, g['risk_b'])} THEN 'risk_customer_ranking'
 WHEN {_any(q, g['quality'])} THEN 'data_quality'
 WHEN {_any(q, g['overview_a'])} AND {_any(q, g['overview_b'])} THEN 'dataset_overview'
 WHEN {_any(q, g['market'])} THEN 'market_recommendation'
 WHEN {_any(q, g['top_a'])} AND {_any(q, g['top_b'])} THEN 'top_records'
 WHEN {_any(q, g['correlation'])} THEN 'correlation' WHEN {_any(q, g['trend'])} THEN 'time_trend'
 WHEN {_any(q, g['distribution'])} THEN 'distribution' WHEN {_any(q, g['outlier'])} THEN 'outlier'
 WHEN {_any(q, g['group'])} AND {_any(q, g['count'])} THEN 'count_by_dimension' WHEN {_any(q, g['group'])} THEN 'group_aggregate'
 WHEN {_any(q, g['count_only'])} THEN 'count_by_dimension' ELSE 'describe' END"""


def _agg_sql(goal: str) -> str:
    parts = [f"WHEN {goal} = 'count_by_dimension' OR {_any(_Q, R.GOAL_RULES['count'])} THEN 'count'"]
    parts += [f"WHEN {_any(_Q, words)} THEN '{name}'" for name, words in R.AGG_RULES]
    return "CASE " + " ".join(parts) + " ELSE 'avg' END"


@query("r1_triage_answerability", f"SELECT q_id, {_triage_sql('question')} AS category FROM v_q")
def r1_triage_answerability(spark, sf_dir):
    """Answerability category of every logged question."""
    q = Views(spark, sf_dir).v_q
    return q.select("q_id", R.triage_answerability("question").alias("category"))


@query("r1_triage_conversations", f"SELECT conv_id, turn, {_triage_sql('text')} AS category FROM conversations WHERE role = 'user'")
def r1_triage_conversations(spark, sf_dir):
    """Answerability category of every user turn (whole text)."""
    c = Views(spark, sf_dir).conversations.where(F.col("role") == "user")
    return c.select("conv_id", "turn", R.triage_answerability("text").alias("category"))


@query("r2_classify_goal", f"SELECT q_id, {_goal_sql()} AS goal FROM v_q")
def r2_classify_goal(spark, sf_dir):
    """Analysis goal of every logged question."""
    q = Views(spark, sf_dir).v_q
    return q.select("q_id", R.classify_goal("question").alias("goal"))


@query("r3_classify_aggregation", f"SELECT q_id, {_agg_sql(_goal_sql())} AS aggregation FROM v_q")
def r3_classify_aggregation(spark, sf_dir):
    """Aggregation word of every logged question."""
    q = Views(spark, sf_dir).v_q
    return q.select("q_id", R.classify_aggregation("question", R.classify_goal("question")).alias("aggregation"))


def _template_sql() -> str:
    rules = [
        " AND ".join([{None: "TRUE"}.get(flag, (flag or "").replace("!", "NOT ")), *[_any(_Q, words) for words in groups]]) + f" THEN '{name}'"
        for name, flag, groups in R.TEMPLATE_RULES
    ]
    return "CASE " + " ".join(f"WHEN {r}" for r in rules) + " END"


_SUBS_COLS = ["row_key", "customer_id", "company", "month", "mrr", "renewal_risk", "manager", "payment_status", "invoice_amount", "overdue_days",
              "channel", "industry", "segment", "plan", "churn", "nps", "csat", "usage_hours", "active_users", "tickets", "sla_breaches"]


@query(
    "r4_classify_template",
    f"""SELECT q_id, dataset, {_template_sql()} AS template FROM v_ask,
 (VALUES ('subscriptions', TRUE, FALSE, FALSE), ('sales', FALSE, TRUE, FALSE), ('pipeline', FALSE, FALSE, TRUE)) AS f(dataset, has_saas, has_sales, has_pipeline)""",
)
def r4_classify_template(spark, sf_dir):
    """Business template of every question against three datasets (a flags row
    for each, from its column names)."""
    v = Views(spark, sf_dir)
    datasets = {
        "subscriptions": v.v_subs.columns,
        "sales": v.v_sales.withColumnsRenamed({"status": "订单状态", "product": "商品名称"}).columns,
        "pipeline": v.v_pipe.withColumnsRenamed({"amount": "商机金额", "stage": "销售阶段"}).columns,
    }
    rows = [(name, *[R.dataset_flags(cols)[k] for k in ("has_saas", "has_sales", "has_pipeline")]) for name, cols in datasets.items()]
    flags = spark.createDataFrame(rows, "dataset string, has_saas boolean, has_sales boolean, has_pipeline boolean")
    j = v.v_ask.crossJoin(F.broadcast(flags))  # one row a dataset
    return j.select("q_id", "dataset", R.classify_template("question", F.col("has_saas"), F.col("has_sales"), F.col("has_pipeline")).alias("template"))


_MONTH_RE2 = r"(1[0-2]|[1-9])\s*月"


_R5_SQL = f"""WITH m AS (SELECT q_id, question, regexp_extract_all(question, '{R.PERIOD_RE}|{_MONTH_RE2}') AS both_m, regexp_extract(question, '{R.YEAR_RE}', 1) AS yr,
 len(regexp_extract_all(question, '{_MONTH_RE2}', 1)) AS n_months FROM v_q),
p AS (SELECT q_id, pl FROM (SELECT q_id, list_filter(list_transform(both_m, lambda x: CASE WHEN regexp_extract(x, '{R.PERIOD_RE}', 1) <> ''
 THEN printf('%04d-%02d', CAST(regexp_extract(x, '{R.PERIOD_RE}', 1) AS INTEGER), CAST(regexp_extract(x, '{R.PERIOD_RE}', 2) AS INTEGER))
 WHEN yr <> '' AND n_months >= 2 THEN printf('%04d-%02d', CAST(yr AS INTEGER), CAST(regexp_extract(x, '{_MONTH_RE2}', 1) AS INTEGER)) END), lambda y: y IS NOT NULL) AS pl FROM m)),
d AS (SELECT q_id, list_filter(pl, lambda x, i: list_position(pl, x) = i) AS list_distinct_ordered FROM p)
SELECT q_id, array_to_string(list_distinct_ordered, '|') AS periods, CASE WHEN len(list_distinct_ordered) >= 2 THEN list_distinct_ordered[1] END AS start_period,
 CASE WHEN len(list_distinct_ordered) >= 2 THEN list_distinct_ordered[-1] END AS end_period FROM d"""


@query("r5_extract_periods", _R5_SQL)
def r5_extract_periods(spark, sf_dir):
    """Year-month mentions of every question."""
    q = Views(spark, sf_dir).v_q
    p = q.select("q_id", R.extract_periods("question").alias("p"))
    return p.select("q_id", F.array_join("p.periods", "|").alias("periods"), "p.start_period", "p.end_period")


@query("r5_extract_periods_ask", _R5_SQL.replace("v_q", "v_ask"))
def r5_extract_periods_ask(spark, sf_dir):
    """Year-month mentions of business questions: two months of one year, with
    start and end, single months, and none."""
    p = Views(spark, sf_dir).v_ask.select("q_id", R.extract_periods("question").alias("p"))
    return p.select("q_id", F.array_join("p.periods", "|").alias("periods"), "p.start_period", "p.end_period")


@query(
    "r6_extract_month",
    "SELECT q_id, CASE WHEN regexp_extract(question, '" + _MONTH_RE2 + "', 1) <> '' THEN CAST(regexp_extract(question, '" + _MONTH_RE2 + "', 1) AS INTEGER) "
    + " ".join(f"WHEN contains(lower(question), '{n}') THEN {v}" for n, v in R.MONTH_NAMES)
    + " END AS month FROM v_q",
)
def r6_extract_month(spark, sf_dir):
    """Month-of-year mention of every question."""
    q = Views(spark, sf_dir).v_q
    return q.select("q_id", R.extract_month("question").alias("month"))


@query(
    "r7_split_questions",
    """SELECT q_id, CAST(unnest(range(len(parts))) AS INTEGER) AS pos, unnest(parts) AS part FROM (SELECT q_id, list_filter(list_transform(string_split_regex(trim(question), '[？?；;。]+'),
 lambda p: trim(p, ' ，,、：:')), lambda p: length(p) >= 2) AS parts FROM v_q)""",
)
def r7_split_questions(spark, sf_dir):
    """Sub-questions of every compound question (merge rules via fold)."""
    q = Views(spark, sf_dir).v_q
    return q.select("q_id", F.posexplode(R.split_questions("question")).alias("pos", "part"))


def _r8_sql() -> str:
    cols = list(dict.fromkeys(
        ["order_id", "line_no", "order_date", "city", "category", "product", "status", "quantity", "unit_price", "discount_rate", "sales", "cost",
         "profit", "profit_rate", "payment_method", "channel"] + _SUBS_COLS
    ))
    arr = "[" + ", ".join(_lit(c) for c in cols) + "]"
    return (
        f"SELECT q_id, unnest(list_filter({arr}, lambda c: contains(lower(question), lower(c)) OR "
        f"contains(regexp_replace(lower(question), '\\s+', '', 'g'), regexp_replace(lower(c), '\\s+', '', 'g')))) AS \"column\" FROM v_q"
    )


def _catalog(v):
    return list(dict.fromkeys(v.v_sales.columns + v.v_subs.columns))


@query("r8_link_columns", _r8_sql())
def r8_link_columns(spark, sf_dir):
    """Catalog columns named in each question."""
    v = Views(spark, sf_dir)
    return v.v_q.select("q_id", F.explode(R.link_columns("question", _catalog(v))).alias("column"))


@query(
    "r9_link_values",
    """WITH kv AS (SELECT 'n_name' AS "column", min(trim(n_name)) AS value FROM nation WHERE length(trim(n_name)) > 0 GROUP BY lower(trim(n_name))),
c AS (SELECT q.q_id, kv."column", kv.value, length(lower(kv.value)) + CASE WHEN contains(lower(q.question), lower(kv."column")) THEN 100 ELSE 0 END AS score
 FROM v_q q, kv WHERE length(kv.value) BETWEEN 2 AND 80 AND (CASE WHEN regexp_matches(lower(kv.value), '^[a-z0-9_.-]+$')
 THEN regexp_matches(lower(q.question), '(^|[^a-z0-9_])' || replace(lower(kv.value), '.', '\\.') || '([^a-z0-9_]|$)') ELSE contains(lower(q.question), lower(kv.value)) END))
SELECT q_id, "column", arg_max(value, (score, value)) AS value FROM c GROUP BY q_id, "column\"""",
)
def r9_link_values(spark, sf_dir):
    """Nation names in each question, from all distinct values."""
    v = Views(spark, sf_dir)
    known = P.known_values(v.nation, ["n_name"])
    return R.link_values(v.v_q, "q_id", "question", known, ["n_name"])


_R10_SQL = (
    "SELECT q_id, m.name AS metric FROM (SELECT q_id, unnest(list_filter(["
    + ", ".join("{'name': " + _lit(n) + ", 'aliases': [" + ", ".join(_lit(a.lower()) for a in al) + "]}" for n, al, _, _ in R.METRICS)
    + "], lambda m: list_bool_or(list_transform(m.aliases, lambda a: contains(lower(coalesce(question, '')), a))))) AS m FROM v_q)"
)


@query("r10_metric_notes", _R10_SQL)
def r10_metric_notes(spark, sf_dir):
    """Registry metrics mentioned by each question."""
    q = Views(spark, sf_dir).v_q
    return q.select("q_id", F.explode(R.metric_notes(F.col("question"))).alias("metric"))


@query("r10_metric_notes_ask", _R10_SQL.replace("v_q", "v_ask"))
def r10_metric_notes_ask(spark, sf_dir):
    """Registry metrics mentioned by each business question (all nine)."""
    q = Views(spark, sf_dir).v_ask
    return q.select("q_id", F.explode(R.metric_notes(F.col("question"))).alias("metric"))


# places in name order; the first one in the question counts
_PLACES_SQL = """p AS (SELECT name, row_number() OVER (ORDER BY name) AS pos FROM (SELECT n_name AS name FROM nation UNION SELECT r_name FROM region)),
h AS (SELECT q_id, arg_min(name, pos) AS city FROM v_ask, p WHERE regexp_matches(lower(question), CASE WHEN regexp_matches(lower(name), '^[a-z0-9_.-]+$')
 THEN '(^|[^a-z0-9_])' || lower(name) || '([^a-z0-9_]|$)' ELSE lower(name) END) GROUP BY q_id)"""


def _places(v):
    """Nation and region names, numbered in name order (a few dozen rows)."""
    names = v.nation.select(F.col("n_name").alias("value")).union(v.region.select("r_name")).distinct()
    one = names.agg(F.array_sort(F.collect_list("value")).alias("_all"))
    return one.select(F.posexplode("_all").alias("pos", "value"))


def _geo_column(columns):
    return next((c for w in R.GEO_WORDS for c in columns if w in c.lower()), None)


@query("r11_missing_value_check", f"WITH {_PLACES_SQL} SELECT q_id, city, 'no_geo_column' AS issue FROM h")
def r11_missing_value_check(spark, sf_dir):
    """Places asked for on the customer table, which has no geo column."""
    v = Views(spark, sf_dir)
    return R.missing_value_check(v.v_ask, "q_id", "question", _places(v), _geo_column(v.customer.columns))


@query(
    "r11_missing_value_check_region",
    f"WITH {_PLACES_SQL} SELECT q_id, city, 'value_not_found' AS issue FROM h WHERE lower(city) NOT IN (SELECT lower(r_name) FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)",
)
def r11_missing_value_check_region(spark, sf_dir):
    """Places asked for on the suppliers by region: regions are there, nations not."""
    v = Views(spark, sf_dir)
    suppliers = v.supplier.join(v.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(v.region, F.col("n_regionkey") == F.col("r_regionkey"))
    suppliers = suppliers.select("s_suppkey", F.col("r_name").alias("region"))
    geo = _geo_column(suppliers.columns)
    return R.missing_value_check(v.v_ask, "q_id", "question", _places(v), geo, P.known_values(suppliers, [geo]))


@query(
    "r12_missing_role_check",
    f"""SELECT q_id, CASE WHEN ({_goal_sql()}) = 'top_records' AND {_any(_Q, [w.lower() for w in R.PRODUCT_NAME_ASK])} THEN 'unanswerable_missing_product_name' END AS issue FROM v_ask""",
)
def r12_missing_role_check(spark, sf_dir):
    """Top-records questions asking for a product name on customer, which has
    none; the others have no issue."""
    v = Views(spark, sf_dir)
    chk = R.missing_role_check("question", R.classify_goal("question"), v.customer.columns)
    return v.v_ask.select("q_id", chk.alias("issue"))


_CUST_COLS = [c for c, _ in CUSTOMER_COLS]


@query(
    "r13_needs_clarification",
    f"""WITH t AS (SELECT count_if(logical_type = 'numeric') AS nn, count_if(logical_type = 'categorical') AS nc, count_if(logical_type = 'datetime') AS nd FROM ({_types_sql('customer', CUSTOMER_COLS, 'c_custkey')})),
g AS (SELECT q_id, question, {_goal_sql()} AS goal FROM v_ask),
n AS (SELECT *, (goal = 'correlation' AND nn < 2) OR (goal IN ('group_aggregate', 'count_by_dimension', 'top_records', 'market_recommendation') AND nc = 0)
 OR (goal IN ('group_aggregate', 'distribution', 'outlier', 'top_records', 'market_recommendation', 'mrr_snapshot_vs_cumulative', 'risk_customer_ranking', 'describe') AND nn = 0)
 OR (goal = 'time_trend' AND (nd = 0 OR nn = 0)) AS need FROM g, t)
SELECT q_id, need AS needs_clarification, CASE WHEN need THEN 'clarification' ELSE goal END AS analysis_goal,
 CASE WHEN len(list_filter([{', '.join(_lit(c) for c in _CUST_COLS)}], lambda c: contains(lower(question), lower(c)))) > 0 THEN CAST(0.65 AS DOUBLE) ELSE CAST(0.45 AS DOUBLE) END AS confidence FROM n""",
)
def r13_needs_clarification(spark, sf_dir):
    """Clarification need of each question against the customer table's P2
    rows: it has no time column, so trends lack one."""
    v = Views(spark, sf_dir)
    roles = R.role_counts(P.logical_types(v.customer, ["c_custkey"]))  # one row
    goal = R.classify_goal("question")
    mentioned = R.link_columns("question", v.customer.columns)
    chk = R.needs_clarification(goal, mentioned, F.col("n_numeric"), F.col("n_categorical"), F.col("n_datetime"))
    asked = v.v_ask.crossJoin(F.broadcast(roles))
    return asked.select("q_id", chk.alias("c")).select("q_id", "c.needs_clarification", "c.analysis_goal", "c.confidence")


@query(
    "a21_plan_dedup",
    f"""WITH ops AS (SELECT q_id, {_goal_sql()} AS goal, {_agg_sql(_goal_sql())} AS aggregation FROM v_q)
SELECT goal, aggregation, min(q_id) AS q_id FROM ops GROUP BY goal, aggregation""",
)
def a21_plan_dedup(spark, sf_dir):
    """Equal (goal, aggregation) operations of the question log run once."""
    q = Views(spark, sf_dir).v_q
    g = R.classify_goal("question")
    ops = q.select("q_id", g.alias("goal"), R.classify_aggregation("question", g).alias("aggregation"))
    return A.plan_dedup(ops, ["goal", "aggregation"], "q_id").select("goal", "aggregation", "q_id")
