"""Task / event / token-usage log analytics (batch).

The reference keeps these logs in SQLite and answers one task at a time; here
every operator runs over the whole log.  Joins are plain equi-joins (Spark
picks broadcast or sort-merge from sizes; AQE splits skewed task ids);
"previous event" and "running total" per task use
:mod:`quarry.functions.sequential` so one busy task does not become one
executor's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.sequential import keyed_lag, keyed_running_sum

# Prices per 1,000 tokens, default budget, timeout, retention,
# payload cut, terminal statuses, CJK range of the token estimate.
INPUT_PRICE_PER_1K = 0.00015
OUTPUT_PRICE_PER_1K = 0.0006
DEFAULT_TOKEN_BUDGET = 50000
TASK_TIMEOUT_SECONDS = 120
EVENT_RETENTION_DAYS = 7
PAYLOAD_MAX_CHARS = 600
FINISHED = ["succeeded", "failed", "cancelled"]
RETRYABLE = ["failed", "cancelled"]
RESUMABLE = ["queued", "running"]
CJK_CLASS = "[^一-鿿]"


def _page(ordered: DataFrame, limit: int | None) -> DataFrame:
    return ordered if limit is None else ordered.limit(max(1, int(limit)))


def replay_from_cursor(log: DataFrame, task_id, cursor: int = 0, limit: int | None = 500, task_col: str = "task_id", seq: str = "sequence_id") -> DataFrame:
    """O1: events of a task after the cursor, ascending: a page of ``limit``
    (the next one starts after its last ``seq``), or all with None."""
    return _page(log.where((F.col(task_col) == task_id) & (F.col(seq) > cursor)).orderBy(seq), limit)


def latest_status(log: DataFrame, task_col: str = "task_id", seq: str = "sequence_id") -> DataFrame:
    """O2: status of each task = status of its newest event."""
    return log.groupBy(task_col).agg(
        F.max_by("status", seq).alias("status"), F.max(seq).alias("last_sequence_id"), F.count(F.lit(1)).alias("events")
    )


def status_counts(tasks: DataFrame) -> DataFrame:
    """O3: tasks per status plus total/running/succeeded/failed in one row each."""
    per = tasks.groupBy("status").agg(F.count(F.lit(1)).alias("tasks"))
    summary = tasks.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "running").alias("running"),
        F.count_if(F.col("status") == "succeeded").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
    return per.crossJoin(summary)


def task_table(log: DataFrame) -> DataFrame:
    """Task records derived from the event log: tenant, status, start/end."""
    return log.groupBy("task_id").agg(
        F.max_by("tenant_id", "sequence_id").alias("tenant_id"),
        F.max_by("status", "sequence_id").alias("status"),
        F.min("ts").alias("started_at"),
        F.max("ts").alias("updated_at"),
    )


def usage_cost(usage: DataFrame) -> DataFrame:
    """O6 per usage: total tokens and cost (8 dp)."""
    cost = F.round(F.col("prompt_tokens") / 1000 * INPUT_PRICE_PER_1K + F.col("completion_tokens") / 1000 * OUTPUT_PRICE_PER_1K, 8)
    return usage.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens")).withColumn("estimated_cost_usd", cost)


def task_token_totals(usage: DataFrame) -> DataFrame:
    """O6 per task: accumulated tokens and cost."""
    return usage_cost(usage).groupBy("task_id").agg(
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("total_tokens").alias("total_tokens"), F.round(F.sum("estimated_cost_usd"), 8).alias("estimated_cost_usd"),
    )


def provider_token_totals(usage: DataFrame, tasks: DataFrame, tenant: str | None = None) -> DataFrame:
    """Σtokens and Σcost of provider-reported usage joined to tasks
    (inner equi-join), tenant scoped; 0 when nothing matches."""
    t = tasks.where(F.col("tenant_id") == tenant) if tenant else tasks
    u = usage_cost(usage).where(F.col("source") == "provider")
    j = u.join(t.select("task_id"), "task_id")
    return j.agg(
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.round(F.sum("estimated_cost_usd"), 8), F.lit(0.0)).alias("estimated_cost_usd"),
    )


def payload_byte_totals(usage: DataFrame, tasks: DataFrame, tenant: str | None = None) -> DataFrame:
    """Σ output bytes of payload metrics joined to tasks, tenant scoped."""
    t = tasks.where(F.col("tenant_id") == tenant) if tenant else tasks
    return usage.join(t.select("task_id"), "task_id").agg(F.coalesce(F.sum("output_bytes"), F.lit(0)).alias("output_bytes"))


def estimate_tokens(text: Column) -> Column:
    """0 for empty text, else max(1, ⌊1.2·CJK + others/4⌋)."""
    total = F.coalesce(F.length(text), F.lit(0))
    cjk = F.length(F.regexp_replace(text, CJK_CLASS, ""))
    est = F.greatest(F.lit(1), F.floor(cjk * 1.2 + (total - cjk) / 4).cast("bigint"))
    return F.when(total == 0, F.lit(0).cast("bigint")).otherwise(est)


def payload_metrics(df: DataFrame, input_col: str | None, output_col: str) -> DataFrame:
    """Input chars, output chars, output UTF-8 bytes and the number of
    result rows in an output JSON payload (``execution_result.tables[*].rows``)."""
    rows_json = F.get_json_object(F.col(output_col), "$.execution_result.tables")
    tables = F.from_json(rows_json, "array<struct<rows:array<string>>>")
    n_rows = F.coalesce(F.aggregate(F.transform(tables, lambda t: F.coalesce(F.size(t["rows"]), F.lit(0))), F.lit(0), lambda a, b: a + b), F.lit(0))
    return df.select(
        "*",
        (F.length(F.col(input_col)) if input_col else F.lit(0)).alias("input_chars"),
        F.length(F.col(output_col)).alias("output_chars"),
        F.octet_length(F.col(output_col)).alias("output_bytes"),
        n_rows.alias("output_rows"),
    )


def trace_listing(log: DataFrame, task_id) -> DataFrame:
    """Spans (events) of one task by start time."""
    return log.where(F.col("task_id") == task_id).orderBy("ts", "sequence_id")


def node_durations(log: DataFrame) -> DataFrame:
    """Duration of each node = gap to the previous event of its task (ms);
    the first event of a task has none."""
    lagged = keyed_lag(log.select("task_id", "sequence_id", "ts", "node"), ["task_id"], ["sequence_id"], ["ts"])
    ms = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("prev_ts").cast("timestamp"))) / 1000
    return lagged.select("task_id", "sequence_id", "node", F.floor(ms).cast("bigint").alias("duration_ms"))


def task_durations(log: DataFrame) -> DataFrame:
    """Finish − start in ms, final status, error flag per task."""
    g = log.groupBy("task_id").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("finished_at"),
        F.max_by("status", "sequence_id").alias("final_status"),
        F.max_by("node", F.when(F.col("status") == "failed", F.col("sequence_id"))).alias("error"),
    )
    ms = (F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1000
    return g.withColumn("duration_ms", F.floor(ms).cast("bigint"))


def token_budget_breach(usage: DataFrame, budget: int = DEFAULT_TOKEN_BUDGET) -> DataFrame:
    """First usage at which a task's running token total exceeds budget."""
    u = usage_cost(usage)
    run = keyed_running_sum(u, ["task_id"], ["created_at", "usage_id"], "total_tokens", "running_tokens")
    over = run.where(F.col("running_tokens") > budget)
    return over.groupBy("task_id").agg(
        F.min_by("usage_id", F.struct("created_at", "usage_id")).alias("usage_id"),
        F.min_by("running_tokens", F.struct("created_at", "usage_id")).alias("running_tokens"),
    )


def timeout_flags(durations: DataFrame, timeout_seconds: int = TASK_TIMEOUT_SECONDS) -> DataFrame:
    """Tasks whose run time exceeds the timeout."""
    return durations.where(F.col("duration_ms") > timeout_seconds * 1000)


def incomplete_tasks(tasks: DataFrame) -> DataFrame:
    """queued/running tasks are reset to queued (resume); failed or
    cancelled ones are eligible for retry; others are rejected."""
    action = (
        F.when(F.col("status").isin(RESUMABLE), "resume")
        .when(F.col("status").isin(RETRYABLE), "retry")
        .otherwise("reject")
    )
    new_status = F.when(F.col("status").isin(RESUMABLE + RETRYABLE), "queued").otherwise(F.col("status"))
    return tasks.select("task_id", "status", action.alias("action"), new_status.alias("new_status"))


def log_retention_cascade(log: DataFrame, tasks: DataFrame, now: str, retention_days: int = EVENT_RETENTION_DAYS,
                          children: dict[str, DataFrame] | None = None) -> tuple[DataFrame, ...]:
    """Finished tasks last updated before ``now − max(1, days)`` are
    expired with all their events.  Returns (kept events, deleted task ids):
    a left-anti join keeps, the expired key set is the delete list.  With
    ``children`` (token usage, payload metrics, spans, ... by ``task_id``) also
    their kept rows, by name."""
    cutoff = F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(max(1, retention_days)))
    expired = tasks.where(F.col("status").isin(FINISHED) & (F.col("updated_at").cast("timestamp") < cutoff)).select("task_id")
    kept = log.join(expired, "task_id", "left_anti")
    if children is None:
        return kept, expired
    return kept, expired, {name: rows.join(expired, "task_id", "left_anti") for name, rows in children.items()}


def task_listing(tasks: DataFrame, tenant: str | None = None, limit: int | None = 100, after: tuple | None = None) -> DataFrame:
    """Tenant scope, newest first; a page of ``limit`` (None: all) that
    starts after the (updated_at, task_id) ``after`` of the last page."""
    t = tasks.where(F.col("tenant_id") == tenant) if tenant else tasks
    if after:
        when, task = F.lit(after[0]).cast(t.schema["updated_at"].dataType), after[1]
        t = t.where((F.col("updated_at") < when) | ((F.col("updated_at") == when) & (F.col("task_id") > task)))
    return _page(t.orderBy(F.col("updated_at").desc(), F.col("task_id")), limit)


def usage_visible_to_owner(usage: DataFrame, tasks: DataFrame, tenant: str, limit: int | None = 100) -> DataFrame:
    """Usage rows whose task belongs to the caller (left-semi join),
    newest first."""
    mine = tasks.where(F.col("tenant_id") == tenant).select("task_id")
    return _page(usage.join(mine, "task_id", "left_semi").orderBy(F.col("created_at").desc(), F.col("usage_id")), limit)


def eval_rollup(cases: DataFrame, run_col: str, passed_col: str) -> DataFrame:
    """Total, passed, failed per run; succeeded iff nothing failed."""
    g = cases.groupBy(run_col).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col(passed_col)).alias("passed"), F.count_if(~F.col(passed_col)).alias("failed")
    )
    return g.withColumn("status", F.when(F.col("failed") == 0, "succeeded").otherwise("failed"))


def latest_eval(runs: DataFrame, run_col: str, created_col: str) -> DataFrame:
    """The newest run (ties: largest run id)."""
    return runs.agg(F.max_by(F.struct(*runs.columns), F.struct(created_col, run_col)).alias("r")).select("r.*")


def upsert_by_key(base: DataFrame, updates: DataFrame, key: list[str], created_col: str | None = None) -> DataFrame:
    """Insert-or-update by key with a full outer join: new keys are
    inserted, changed rows take the update (keeping the original created_at),
    identical rows are skipped.  Adds ``change`` = insert/update/unchanged."""
    value_cols = [c for c in base.columns if c not in key and c != created_col]
    b = base.select(*key, *[F.col(c).alias(f"_b_{c}") for c in base.columns if c not in key], F.lit(True).alias("_in_b"))
    u = updates.select(*key, *[F.col(c).alias(f"_u_{c}") for c in updates.columns if c not in key], F.lit(True).alias("_in_u"))
    j = b.join(u, key, "full_outer")
    same = F.lit(True)
    for c in value_cols:
        same = same & F.col(f"_b_{c}").eqNullSafe(F.col(f"_u_{c}"))
    change = F.when(F.col("_in_u").isNull(), "unchanged").when(F.col("_in_b").isNull(), "insert").when(same, "unchanged").otherwise("update")
    out = [*[F.col(k) for k in key]]
    for c in [c for c in base.columns if c not in key]:
        if c == created_col:
            out.append(F.coalesce(F.col(f"_b_{c}"), F.col(f"_u_{c}")).alias(c))
        else:
            out.append(F.when(F.col("_in_u").isNotNull(), F.col(f"_u_{c}")).otherwise(F.col(f"_b_{c}")).alias(c))
    return j.select(*out, change.alias("change"))


def safe_log_id(c: Column) -> Column:
    """Key sanitising of O20: non [alnum - _] → '-', or 'unknown' if empty.
    Long keys stay whole, so two cases never share a log row."""
    s = F.regexp_replace(c.cast("string"), r"[^\p{L}\p{N}_-]", "-")
    return F.when(F.length(s) > 0, s).otherwise("unknown")


def eval_failure_sync(results: DataFrame, log: DataFrame, id_col: str, passed_col: str) -> DataFrame:
    """Failed case → open log row; passed case with an unresolved log
    row → resolved; passed without a log row → nothing.  Full outer join of
    results with the improvement log on the sanitised key."""
    r = results.select(F.concat(F.lit("eval-failure-"), safe_log_id(F.col(id_col))).alias("log_id"), F.col(passed_col).alias("_passed"))
    j = r.join(log.select("log_id", F.col("status").alias("_old")), "log_id", "left")
    new = (
        F.when(~F.col("_passed"), "open")
        .when(F.col("_old").isNotNull() & (F.col("_old") != "resolved"), "resolved")
    )
    return j.select("log_id", F.col("_old").alias("old_status"), new.alias("new_status")).where(F.col("new_status").isNotNull())


def http_request_metrics(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Request counts by (method, route, status) and duration count/sum
    by (method, route)."""
    counts = events.groupBy("method", "route", "status").agg(F.count(F.lit(1)).alias("requests"))
    durations = events.groupBy("method", "route").agg(F.count(F.lit(1)).alias("duration_count"), F.sum("duration_s").alias("duration_sum"))
    return counts, durations


def redact_payload(payload: Column, display_chars: int | None = None) -> Column:
    """In a JSON object payload, replace the preview rows, profile, result
    rows and report text by counts and names (other keys keep their place and
    value); compact JSON.  Other text stays as it is.  With ``display_chars``
    a longer value is cut to that many characters, the last three '...'."""
    obj = F.from_json(payload, "map<string,variant>")
    preview_n = F.json_array_length(F.get_json_object(payload, "$.dataset_preview"))
    prof = F.from_json(F.get_json_object(payload, "$.profile"), "struct<row_count:bigint,column_count:bigint,columns:array<struct<name:string>>>")
    res = F.from_json(F.get_json_object(payload, "$.execution_result"), "struct<kind:string,source:string,tables:array<struct<name:string,rows:array<string>>>>")
    report = F.get_json_object(payload, "$.report_markdown")
    as_variant = lambda c: F.parse_json(F.to_json(c))
    red_preview = as_variant(F.struct(F.lit(True).alias("redacted"), preview_n.alias("row_count")))
    red_profile = as_variant(F.struct(prof["row_count"].alias("row_count"), prof["column_count"].alias("column_count"), F.transform(prof["columns"], lambda x: x["name"]).alias("columns")))
    red_result = as_variant(F.struct(res["kind"].alias("kind"), res["source"].alias("source"),
                                     F.transform(res["tables"], lambda t: F.struct(t["name"].alias("name"), F.size(t["rows"]).alias("row_count"))).alias("tables")))
    red_report = as_variant(F.struct(F.lit(True).alias("redacted"), F.length(report).alias("characters")))
    redacted = F.transform_values(
        obj,
        lambda k, v: F.when((k == "dataset_preview") & preview_n.isNotNull(), red_preview)
        .when((k == "profile") & prof.isNotNull(), red_profile)
        .when((k == "execution_result") & res.isNotNull(), red_result)
        .when((k == "report_markdown") & report.isNotNull(), red_report)
        .otherwise(v),
    )
    compact = F.when(obj.isNotNull(), F.to_json(redacted)).otherwise(payload)
    if display_chars is None:
        return compact
    return F.when(F.length(compact) > display_chars, F.concat(F.substring(compact, 1, display_chars - 3), F.lit("..."))).otherwise(compact)
