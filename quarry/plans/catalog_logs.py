"""Registered queries for O1–O22 over v_log / v_tok / labels, with oracles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import logs as O
from quarry.plans.registry import query
from quarry.session import scratch_path
from quarry.sources.views import Views
from quarry.streaming.upserts import UpsertTable

_TASKS_SQL = """tasks AS (SELECT task_id, arg_max(tenant_id, sequence_id) AS tenant_id, arg_max(status, sequence_id) AS status,
 min(ts) AS started_at, max(ts) AS updated_at FROM v_log GROUP BY task_id)"""
_COST = "round(prompt_tokens / 1000 * 0.00015 + completion_tokens / 1000 * 0.0006, 8)"


def _tasks(v):
    return O.task_table(v.v_log)


@query("o1_replay_from_cursor", "SELECT * FROM v_log WHERE task_id = 8 AND sequence_id > 100 ORDER BY sequence_id LIMIT 1000")
def o1_replay_from_cursor(spark, sf_dir):
    """Events of task 8 after cursor 100."""
    return O.replay_from_cursor(Views(spark, sf_dir).v_log, 8, 100, 1000)


@query("o2_latest_status", "SELECT task_id, arg_max(status, sequence_id) AS status, max(sequence_id) AS last_sequence_id, count(*) AS events FROM v_log GROUP BY task_id")
def o2_latest_status(spark, sf_dir):
    """Status of every task from its newest event."""
    return O.latest_status(Views(spark, sf_dir).v_log)


@query(
    "o3_status_counts",
    f"""WITH {_TASKS_SQL}
SELECT status, count(*) AS tasks, (SELECT count(*) FROM tasks) AS total, (SELECT count_if(status = 'running') FROM tasks) AS running,
 (SELECT count_if(status = 'succeeded') FROM tasks) AS succeeded, (SELECT count_if(status = 'failed') FROM tasks) AS failed FROM tasks GROUP BY status""",
)
def o3_status_counts(spark, sf_dir):
    """Tasks per status plus overall counters."""
    return O.status_counts(_tasks(Views(spark, sf_dir)))


@query(
    "o4_provider_token_totals",
    f"""WITH {_TASKS_SQL}
SELECT coalesce(sum(prompt_tokens + completion_tokens), 0) AS total_tokens, coalesce(round(sum({_COST}), 8), 0.0) AS estimated_cost_usd
FROM v_tok u JOIN tasks t ON u.task_id = t.task_id WHERE u.source = 'provider' AND t.tenant_id = 'tenant_1'""",
)
def o4_provider_token_totals(spark, sf_dir):
    """Provider-reported tokens and cost of one tenant's tasks."""
    v = Views(spark, sf_dir)
    return O.provider_token_totals(v.v_tok, _tasks(v), "tenant_1")


@query(
    "o5_payload_byte_totals",
    f"WITH {_TASKS_SQL} SELECT coalesce(sum(output_bytes), 0) AS output_bytes FROM v_tok u JOIN tasks t ON u.task_id = t.task_id WHERE t.tenant_id = 'tenant_2'",
)
def o5_payload_byte_totals(spark, sf_dir):
    """Output bytes of one tenant's tasks."""
    v = Views(spark, sf_dir)
    return O.payload_byte_totals(v.v_tok, _tasks(v), "tenant_2")


@query("o6_usage_cost", f"SELECT *, prompt_tokens + completion_tokens AS total_tokens, {_COST} AS estimated_cost_usd FROM v_tok")
def o6_usage_cost(spark, sf_dir):
    """Total tokens and cost of every usage record."""
    return O.usage_cost(Views(spark, sf_dir).v_tok)


@query(
    "o6_task_token_totals",
    f"""SELECT task_id, sum(prompt_tokens) AS prompt_tokens, sum(completion_tokens) AS completion_tokens, sum(prompt_tokens + completion_tokens) AS total_tokens,
 round(sum({_COST}), 8) AS estimated_cost_usd FROM v_tok GROUP BY task_id""",
)
def o6_task_token_totals(spark, sf_dir):
    """Tokens and cost accumulated per task."""
    return O.task_token_totals(Views(spark, sf_dir).v_tok)


def _est_sql(col: str) -> str:
    cjk = f"length(regexp_replace({col}, '[^一-鿿]', '', 'g'))"
    return f"CASE WHEN coalesce(length({col}), 0) = 0 THEN CAST(0 AS BIGINT) ELSE greatest(1, CAST(floor({cjk} * 1.2 + (length({col}) - {cjk}) / 4) AS BIGINT)) END"


@query("o7_estimate_tokens", f"SELECT doc_id, {_est_sql('text')} AS tokens FROM documents")
def o7_estimate_tokens(spark, sf_dir):
    """Token estimate of every document (whole text)."""
    d = Views(spark, sf_dir).documents
    return d.select("doc_id", O.estimate_tokens(F.col("text")).alias("tokens"))


@query("o7_estimate_tokens_conversations", f"SELECT conv_id, turn, {_est_sql('text')} AS tokens FROM conversations")
def o7_estimate_tokens_conversations(spark, sf_dir):
    """Token estimate of every conversation turn."""
    c = Views(spark, sf_dir).conversations
    return c.select("conv_id", "turn", O.estimate_tokens(F.col("text")).alias("tokens"))


@query("o8_payload_metrics", "SELECT page_id, length(url) AS input_chars, length(html) AS output_chars, octet_length(encode(html)) AS output_bytes, 0 AS output_rows FROM pages")
def o8_payload_metrics(spark, sf_dir):
    """Chars, UTF-8 bytes and JSON result rows of page payloads."""
    p = Views(spark, sf_dir).pages
    return O.payload_metrics(p, "url", "html").select("page_id", "input_chars", "output_chars", "output_bytes", "output_rows")


# a task payload for every turn: two result tables, a preview, a profile and a report
def _payload(cat: str, num: str) -> str:
    parts = [
        """'{"task":'""", num.format("conv_id"), """',"dataset_preview":['""", "repeat('{\"a\":1},', CAST(conv_id % 3 AS INT))",
        """'{"a":2}],"profile":{"row_count":'""", num.format("conv_id * 10"), """',"column_count":2,"columns":[{"name":"a","dtype":"int"},{"name":"b"}]},"execution_result":{"kind":"table","source":"sql","tables":[{"name":"t1","rows":['""",
        "repeat('\"r\",', CAST(turn AS INT))", """'"r"]},{"name":"t2","rows":[]}]},"report_markdown":"'""", "repeat('x', CAST(conv_id % 700 AS INT))", """'"}'""",
    ]
    return f" {cat} ".join(parts)


_PAYLOAD = _payload("||", "CAST({} AS VARCHAR)")


@query(
    "o8_payload_metrics_json",
    f"SELECT conv_id, turn, length(text) AS input_chars, length(p) AS output_chars, octet_length(encode(p)) AS output_bytes, CAST(turn + 1 AS INTEGER) AS output_rows FROM (SELECT *, {_PAYLOAD} AS p FROM conversations)",
)
def o8_payload_metrics_json(spark, sf_dir):
    """The same of result payloads, one a conversation turn, with their result rows."""
    c = Views(spark, sf_dir).conversations.withColumn("payload", F.expr(_payload("||", "CAST({} AS STRING)")))
    return O.payload_metrics(c, "text", "payload").select("conv_id", "turn", "input_chars", "output_chars", "output_bytes", "output_rows")


@query("o9_trace_listing", "SELECT * FROM v_log WHERE task_id = 21 ORDER BY ts, sequence_id")
def o9_trace_listing(spark, sf_dir):
    """Events of task 21 by time."""
    return O.trace_listing(Views(spark, sf_dir).v_log, 21)


@query(
    "o10_node_durations",
    """SELECT task_id, sequence_id, node, CAST(floor((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY task_id ORDER BY sequence_id))) / 1000) AS BIGINT) AS duration_ms FROM v_log""",
)
def o10_node_durations(spark, sf_dir):
    """Gap to the previous event of the same task, in ms (skew-safe lag)."""
    return O.node_durations(Views(spark, sf_dir).v_log)


@query(
    "o11_task_durations",
    """SELECT task_id, min(ts) AS started_at, max(ts) AS finished_at, arg_max(status, sequence_id) AS final_status,
 arg_max(CASE WHEN status = 'failed' THEN node END, sequence_id) AS error, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000) AS BIGINT) AS duration_ms
FROM v_log GROUP BY task_id""",
)
def o11_task_durations(spark, sf_dir):
    """Run time, final status and error per task."""
    return O.task_durations(Views(spark, sf_dir).v_log)


@query(
    "o12_token_budget_breach",
    """WITH r AS (SELECT usage_id, task_id, created_at, sum(prompt_tokens + completion_tokens) OVER (PARTITION BY task_id ORDER BY created_at, usage_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_tokens FROM v_tok)
SELECT task_id, arg_min(usage_id, (created_at, usage_id)) AS usage_id, arg_min(running_tokens, (created_at, usage_id)) AS running_tokens FROM r WHERE running_tokens > 3000 GROUP BY task_id""",
)
def o12_token_budget_breach(spark, sf_dir):
    """First usage where a task's running tokens pass a 3,000 budget."""
    return O.token_budget_breach(Views(spark, sf_dir).v_tok, 3000)


@query(
    "o13_timeout_flags",
    "SELECT * FROM (SELECT task_id, min(ts) AS started_at, max(ts) AS finished_at, arg_max(status, sequence_id) AS final_status, "
    "arg_max(CASE WHEN status = 'failed' THEN node END, sequence_id) AS error, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000) AS BIGINT) AS duration_ms "
    "FROM v_log GROUP BY task_id) WHERE duration_ms > 2400000000",
)
def o13_timeout_flags(spark, sf_dir):
    """Tasks running longer than a 2,400,000 s timeout."""
    return O.timeout_flags(O.task_durations(Views(spark, sf_dir).v_log), 2_400_000)


@query(
    "o14_incomplete_tasks",
    f"""WITH {_TASKS_SQL}
SELECT task_id, status, CASE WHEN status IN ('queued', 'running') THEN 'resume' WHEN status IN ('failed', 'cancelled') THEN 'retry' ELSE 'reject' END AS action,
 CASE WHEN status IN ('queued', 'running', 'failed', 'cancelled') THEN 'queued' ELSE status END AS new_status FROM tasks""",
)
def o14_incomplete_tasks(spark, sf_dir):
    """Resume / retry / reject decision per task."""
    return O.incomplete_tasks(_tasks(Views(spark, sf_dir)))


_EXPIRED = "SELECT task_id FROM tasks WHERE status IN ('succeeded', 'failed', 'cancelled') AND updated_at < TIMESTAMP '2024-02-05 00:00:00' - INTERVAL 7 DAY"


@query("o15_log_retention_cascade", f"WITH {_TASKS_SQL} SELECT task_id, count(*) AS kept_events FROM v_log WHERE task_id NOT IN ({_EXPIRED}) GROUP BY task_id")
def o15_log_retention_cascade(spark, sf_dir):
    """Events kept after expiring finished tasks older than 7 days (anti join)."""
    v = Views(spark, sf_dir)
    kept, _ = O.log_retention_cascade(v.v_log, _tasks(v), "2024-02-05 00:00:00", 7)
    return kept.groupBy("task_id").agg(F.count(F.lit(1)).alias("kept_events"))


@query("o15_log_retention_deleted", f"WITH {_TASKS_SQL} {_EXPIRED}")
def o15_log_retention_deleted(spark, sf_dir):
    """Task ids deleted by the retention cascade."""
    v = Views(spark, sf_dir)
    return O.log_retention_cascade(v.v_log, _tasks(v), "2024-02-05 00:00:00", 7)[1]


@query(
    "o15_log_retention_children",
    f"""WITH {_TASKS_SQL}, gone AS ({_EXPIRED})
SELECT 'token_usage' AS child, count(*) AS kept_rows, count(DISTINCT task_id) AS kept_tasks FROM v_tok WHERE task_id NOT IN (SELECT task_id FROM gone)
UNION ALL SELECT 'payload_metrics', count(*), count(DISTINCT task_id) FROM v_log WHERE payload IS NOT NULL AND task_id NOT IN (SELECT task_id FROM gone)
UNION ALL SELECT 'spans', count(*), count(DISTINCT task_id) FROM v_log WHERE event_type = 'node_completed' AND task_id NOT IN (SELECT task_id FROM gone)""",
)
def o15_log_retention_children(spark, sf_dir):
    """What the cascade keeps of token usage, payload metrics and spans."""
    v = Views(spark, sf_dir)
    log = v.v_log
    children = {
        "token_usage": v.v_tok,
        "payload_metrics": O.payload_metrics(log.where(F.col("payload").isNotNull()), None, "payload"),
        "spans": log.where(F.col("event_type") == "node_completed"),
    }
    _, _, kept = O.log_retention_cascade(log, _tasks(v), "2024-02-05 00:00:00", 7, children)
    counted = [
        rows.agg(F.count(F.lit(1)).alias("kept_rows"), F.countDistinct("task_id").alias("kept_tasks")).select(F.lit(name).alias("child"), "kept_rows", "kept_tasks")
        for name, rows in kept.items()
    ]
    return reduce(DataFrame.unionByName, counted)


@query("o16_task_listing", f"WITH {_TASKS_SQL} SELECT * FROM tasks WHERE tenant_id = 'tenant_3' ORDER BY updated_at DESC, task_id LIMIT 100")
def o16_task_listing(spark, sf_dir):
    """One tenant's tasks, newest first."""
    return O.task_listing(_tasks(Views(spark, sf_dir)), "tenant_3")


@query(
    "o17_usage_visible_to_owner",
    f"WITH {_TASKS_SQL} SELECT * FROM v_tok WHERE task_id IN (SELECT task_id FROM tasks WHERE tenant_id = 'tenant_2') ORDER BY created_at DESC, usage_id LIMIT 100",
)
def o17_usage_visible_to_owner(spark, sf_dir):
    """Usage rows of tenant_2's tasks (left-semi join), newest first."""
    v = Views(spark, sf_dir)
    return O.usage_visible_to_owner(v.v_tok, _tasks(v), "tenant_2")


@query(
    "o18_eval_rollup",
    "SELECT doc_id % 7 AS run_id, count(*) AS total, count_if(quality = 1) AS passed, count_if(NOT (quality = 1)) AS failed, "
    "CASE WHEN count_if(NOT (quality = 1)) = 0 THEN 'succeeded' ELSE 'failed' END AS status FROM labels GROUP BY 1",
)
def o18_eval_rollup(spark, sf_dir):
    """labels as evaluation cases (quality = passed) rolled up per run."""
    lab = Views(spark, sf_dir).labels.select((F.col("doc_id") % 7).alias("run_id"), (F.col("quality") == 1).alias("passed"))
    return O.eval_rollup(lab, "run_id", "passed")


@query(
    "o18_latest_eval",
    "SELECT * FROM (SELECT doc_id % 7 AS run_id, count(*) AS total, count_if(quality = 1) AS passed, count_if(NOT (quality = 1)) AS failed, "
    "CASE WHEN count_if(NOT (quality = 1)) = 0 THEN 'succeeded' ELSE 'failed' END AS status FROM labels GROUP BY 1) ORDER BY run_id DESC LIMIT 1",
)
def o18_latest_eval(spark, sf_dir):
    """Newest evaluation run."""
    lab = Views(spark, sf_dir).labels.select((F.col("doc_id") % 7).alias("run_id"), (F.col("quality") == 1).alias("passed"))
    return O.latest_eval(O.eval_rollup(lab, "run_id", "passed"), "run_id", "run_id")


_UPD = "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name || '_v2' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT n_nationkey + 100, n_name || '_new', n_regionkey FROM nation WHERE n_nationkey < 3"


@query(
    "o19_upsert_by_key",
    f"""WITH u AS ({_UPD})
SELECT coalesce(b.n_nationkey, u.n_nationkey) AS n_nationkey, CASE WHEN u.n_nationkey IS NOT NULL THEN u.n_name ELSE b.n_name END AS n_name,
 CASE WHEN u.n_nationkey IS NOT NULL THEN u.n_regionkey ELSE b.n_regionkey END AS n_regionkey,
 CASE WHEN u.n_nationkey IS NULL THEN 'unchanged' WHEN b.n_nationkey IS NULL THEN 'insert'
 WHEN b.n_name IS NOT DISTINCT FROM u.n_name AND b.n_regionkey IS NOT DISTINCT FROM u.n_regionkey THEN 'unchanged' ELSE 'update' END AS change
FROM nation b FULL OUTER JOIN u ON b.n_nationkey = u.n_nationkey""",
)
def o19_upsert_by_key(spark, sf_dir):
    """nation upserted with a changed slice and new keys (full outer join)."""
    n = Views(spark, sf_dir).nation
    k = F.col("n_nationkey")
    upd = n.where(k % 5 == 0).select(k, F.when(k % 2 == 0, F.concat("n_name", F.lit("_v2"))).otherwise(F.col("n_name")).alias("n_name"), "n_regionkey")
    new = n.where(k < 3).select((k + 100).cast("int").alias("n_nationkey"), F.concat("n_name", F.lit("_new")).alias("n_name"), "n_regionkey")
    return O.upsert_by_key(n, upd.unionByName(new), ["n_nationkey"])


@query(
    "o19_upsert_batches",
    """SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN c_mktsegment || '-1' ELSE c_mktsegment END AS c_mktsegment,
 CASE WHEN c_custkey % 7 = 0 THEN 2 WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS batch FROM customer
UNION ALL SELECT -1 - c_custkey, c_mktsegment, 3 FROM customer""",
)
def o19_upsert_batches(spark, sf_dir):
    """customer as a table of four upserted batches: all rows, new values for
    half of them, then a seventh, then as many new keys; the last batch merges."""
    c = Views(spark, sf_dir).customer
    k, segment = F.col("c_custkey"), F.col("c_mktsegment")
    table = UpsertTable(spark, scratch_path(spark, "o19"), ["c_custkey"])
    batches = [
        c.select(k, segment, F.lit(0).alias("batch")),
        c.where(k % 2 == 0).select(k, F.concat(segment, F.lit("-1")).alias("c_mktsegment"), F.lit(1).alias("batch")),
        c.where(k % 7 == 0).select(k, F.lit(None).cast("string").alias("c_mktsegment"), F.lit(2).alias("batch")),
        c.select((-1 - k).alias("c_custkey"), segment, F.lit(3).alias("batch")),
    ]
    for number, changes in enumerate(batches):
        table.apply(changes, number)
    return table.rows()


@query(
    "o20_eval_failure_sync",
    """WITH lg AS (SELECT 'eval-failure-' || CAST(doc_id AS VARCHAR) AS log_id, CASE WHEN doc_id % 3 = 0 THEN 'open' ELSE 'resolved' END AS status FROM labels WHERE toxic = 1),
r AS (SELECT 'eval-failure-' || CAST(doc_id AS VARCHAR) AS log_id, quality = 1 AS passed FROM labels)
SELECT r.log_id, lg.status AS old_status, CASE WHEN NOT passed THEN 'open' WHEN lg.status IS NOT NULL AND lg.status <> 'resolved' THEN 'resolved' END AS new_status
FROM r LEFT JOIN lg ON r.log_id = lg.log_id WHERE (CASE WHEN NOT passed THEN 'open' WHEN lg.status IS NOT NULL AND lg.status <> 'resolved' THEN 'resolved' END) IS NOT NULL""",
)
def o20_eval_failure_sync(spark, sf_dir):
    """Evaluation results synced into an improvement log."""
    lab = Views(spark, sf_dir).labels
    log = lab.where(F.col("toxic") == 1).select(
        F.concat(F.lit("eval-failure-"), F.col("doc_id").cast("string")).alias("log_id"),
        F.when(F.col("doc_id") % 3 == 0, "open").otherwise("resolved").alias("status"),
    )
    res = lab.select("doc_id", (F.col("quality") == 1).alias("passed"))
    return O.eval_failure_sync(res, log, "doc_id", "passed")


def _http(v):
    e = v.events
    return e.select(
        F.when(F.col("event_type").isin("purchase", "signup"), "POST").otherwise("GET").alias("method"),
        F.concat(F.lit("/api/"), F.col("event_type")).alias("route"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        (F.col("value") / 100).alias("duration_s"),
    )


_HTTP = """h AS (SELECT CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS method, '/api/' || event_type AS route,
 CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, value / 100 AS duration_s FROM events)"""


@query("o21_http_request_metrics", f"WITH {_HTTP} SELECT method, route, status, count(*) AS requests FROM h GROUP BY ALL")
def o21_http_request_metrics(spark, sf_dir):
    """Request counts by method, route and status."""
    return O.http_request_metrics(_http(Views(spark, sf_dir)))[0]


@query("o21_http_duration_metrics", f"WITH {_HTTP} SELECT method, route, count(*) AS duration_count, round(sum(duration_s), 4) AS duration_sum FROM h GROUP BY ALL")
def o21_http_duration_metrics(spark, sf_dir):
    """Duration count and sum by method and route."""
    d = O.http_request_metrics(_http(Views(spark, sf_dir)))[1]
    return d.withColumn("duration_sum", F.round("duration_sum", 4))


@query(
    "o22_redact_payload",
    "SELECT conv_id, turn, text AS payload, CASE WHEN length(text) > 600 THEN left(text, 597) || '...' ELSE text END AS summary FROM conversations",
)
def o22_redact_payload(spark, sf_dir):
    """Conversation turns as payloads, redacted: whole, and cut for display."""
    c = Views(spark, sf_dir).conversations
    return c.select("conv_id", "turn", O.redact_payload(F.col("text")).alias("payload"), O.redact_payload(F.col("text"), O.PAYLOAD_MAX_CHARS).alias("summary"))


_REDACTED = """'{"task":' || CAST(conv_id AS VARCHAR) || ',"dataset_preview":{"redacted":true,"row_count":' || CAST(conv_id % 3 + 1 AS VARCHAR)
 || '},"profile":{"column_count":2,"columns":["a","b"],"row_count":' || CAST(conv_id * 10 AS VARCHAR) || '},"execution_result":{"kind":"table","source":"sql","tables":[{"name":"t1","row_count":'
 || CAST(turn + 1 AS VARCHAR) || '},{"name":"t2","row_count":0}]},"report_markdown":{"characters":' || CAST(conv_id % 700 AS VARCHAR) || ',"redacted":true}}'"""


@query("o22_redact_payload_json", f"SELECT conv_id, turn, {_REDACTED} AS payload FROM conversations")
def o22_redact_payload_json(spark, sf_dir):
    """Result payloads, one a conversation turn, with all four parts redacted."""
    c = Views(spark, sf_dir).conversations.withColumn("payload", F.expr(_payload("||", "CAST({} AS STRING)")))
    return c.select("conv_id", "turn", O.redact_payload(F.col("payload")).alias("payload"))
