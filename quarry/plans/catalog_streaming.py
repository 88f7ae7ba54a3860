"""Registered streaming queries ST1–ST8.  Each runs its stream with
``availableNow`` over the files of ``events`` and returns the sink, which lies
in the shared folder, read back as a batch DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.plans.catalog_logs import _HTTP
from quarry.plans.registry import query
from quarry.session import scratch_path
from quarry.sources.views import Views, v_log, v_tok
from quarry.streaming import ordered
from quarry.streaming import streams as ST

LIMIT, WINDOW = 3, 86400.0
BUDGET = 3000
RETENTION_DAYS = 1




def _by_id():
    return ST.by_id("event_id")


def _by_time():
    return ST.micros("ts")


def _stream_tables(spark, sf_dir):
    return ST.StreamTables(spark, sf_dir, files_per_trigger=ST.FILES_PER_TRIGGER)


def _replayed(spark, sf_dir, name, order, build, after_end_ms=2):
    """``build(stream tables, delay_ms, end)`` over the stored log to its end;
    the delay covers the disorder of the log's files, so no row is late."""
    tables, out, ck = _stream_tables(spark, sf_dir), scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ck")
    delay_ms, last = ordered.log_disorder(spark.read.parquet(tables.path), order)
    end_us = last + (delay_ms + after_end_ms) * 1000
    ordered.replay_to_end(spark, lambda end: build(tables, delay_ms, end), out, ck, end_us)
    return spark.read.parquet(out)


@query("st1_event_log_append", "SELECT * FROM v_log")
def st1_event_log_append(spark, sf_dir):
    """The log appended by a stream equals the batch log."""
    out, ck = scratch_path(spark, "st1-out"), scratch_path(spark, "st1-ck")
    ST.event_log_append(v_log(_stream_tables(spark, sf_dir)), out, ck)
    return spark.read.parquet(out)


@query(
    "st2_cursor_replay_stream",
    "SELECT * FROM (VALUES ('a', 1, (SELECT count(*) FROM events)), ('a', 2, 0), ('b', 1, (SELECT count(*) FROM events)), ('b', 2, 0)) t(reader, run, events)",
)
def st2_cursor_replay_stream(spark, sf_dir):
    """Two independent readers each replay the whole log once; a restart on
    the same checkpoint (cursor) re-reads nothing."""
    st = _stream_tables(spark, sf_dir)
    parts = []
    for reader in ("a", "b"):
        out, ck = scratch_path(spark, f"st2-{reader}"), scratch_path(spark, f"st2-{reader}-ck")
        for run in (1, 2):
            ST.cursor_reader(v_log(st), out, ck, run)
        got = spark.read.parquet(out).groupBy("run").agg(F.count(F.lit(1)).alias("events"))
        runs = spark.createDataFrame([(1,), (2,)], "run int")
        parts.append(runs.join(got, "run", "left").select(F.lit(reader).alias("reader"), "run", F.coalesce("events", F.lit(0)).alias("events")))
    return parts[0].unionByName(parts[1])


@query(
    "st2_replay_until_terminal",
    """WITH s AS (SELECT task_id, min(sequence_id) FILTER (WHERE event_type IN ('task_completed', 'task_failed', 'task_cancelled')) AS stop
 FROM v_log WHERE sequence_id > 100 GROUP BY task_id)
SELECT l.task_id, l.sequence_id, l.event_type, l.status FROM v_log l JOIN s ON l.task_id = s.task_id
WHERE l.sequence_id > 100 AND (s.stop IS NULL OR l.sequence_id <= s.stop)""",
)
def st2_replay_until_terminal(spark, sf_dir):
    """Per-task replay after cursor 100 that stops at the first terminal event
    (stateful flag per task)."""
    return _replayed(spark, sf_dir, "st2r", _by_id(), lambda t, delay, end: ST.replay_until_terminal_stream(v_log(t), 100, delay, end))


@query("st3_live_status", "SELECT task_id, arg_max(status, sequence_id) AS status, max(sequence_id) AS last_sequence_id, count(*) AS events FROM v_log GROUP BY task_id")
def st3_live_status(spark, sf_dir):
    """Streaming current status per task (update mode, upserted) equals O2."""
    out, ck = scratch_path(spark, "st3-out"), scratch_path(spark, "st3-ck")
    ST.upsert_to_table(ST.live_status(v_log(_stream_tables(spark, sf_dir))), out, ck, ["task_id"])
    return ST.latest_rows(spark, out, ["task_id"])


@query("st4_request_metrics_stream", f"WITH {_HTTP} SELECT method, route, status, count(*) AS requests FROM h GROUP BY ALL")
def st4_request_metrics_stream(spark, sf_dir):
    """Streaming request counters (update mode, upserted) equal O21."""
    from quarry.plans.catalog_logs import _http

    out, ck = scratch_path(spark, "st4-out"), scratch_path(spark, "st4-ck")
    keys = ["method", "route", "status"]
    ST.upsert_to_table(ST.request_metrics(_http(_stream_tables(spark, sf_dir))), out, ck, keys)
    return ST.latest_rows(spark, out, keys)


@query("st5_sliding_rate_limiter")
def st5_sliding_rate_limiter(spark, sf_dir):
    """Per-user sliding-window limiter (3 per day) as a stateful stream."""
    return _replayed(
        spark, sf_dir, "st5", _by_time(), lambda t, delay, end: ST.sliding_rate_limiter_stream(t.events, "user_id", LIMIT, WINDOW, delay, end)
    )


@query("st5_rate_limiter_batch")
def st5_rate_limiter_batch(spark, sf_dir):
    """Batch twin of the limiter: sessions split at pauses ≥ window."""
    return ST.sliding_rate_limiter_batch(Views(spark, sf_dir).events, "user_id", LIMIT, WINDOW)


_HB_SQL = """WITH l AS (SELECT task_id, ts, event_type, lag(ts) OVER (PARTITION BY task_id ORDER BY sequence_id) AS prev_ts,
 lag(event_type) OVER (PARTITION BY task_id ORDER BY sequence_id) AS prev_type FROM v_log)
SELECT task_id, CAST(sum(CASE WHEN prev_ts IS NOT NULL AND prev_type NOT IN ('task_completed', 'task_failed', 'task_cancelled')
 THEN greatest(floor((epoch_us(ts) - epoch_us(prev_ts)) / 1e6 / 15), 0) ELSE 0 END) AS BIGINT) AS heartbeats FROM l GROUP BY task_id"""


@query("st6_idle_heartbeat", _HB_SQL)
def st6_idle_heartbeat(spark, sf_dir):
    """Heartbeats owed per task for 15 s silences (batch twin)."""
    return ST.idle_heartbeat_batch(Views(spark, sf_dir).v_log)


@query("st6_idle_heartbeat_stream", _HB_SQL)
def st6_idle_heartbeat_stream(spark, sf_dir):
    """Heartbeats per task from the stateful stream (summed over releases)."""
    parts = _replayed(spark, sf_dir, "st6", _by_id(), lambda t, delay, end: ST.idle_heartbeat_stream(v_log(t), delay_ms=delay, end=end))
    return parts.groupBy("task_id").agg(F.sum("heartbeats").cast("bigint").alias("heartbeats"))


@query(
    "st7_budget_guard_stream",
    f"""WITH r AS (SELECT usage_id, task_id, created_at, sum(prompt_tokens + completion_tokens) OVER (PARTITION BY task_id ORDER BY created_at, usage_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_tokens FROM v_tok)
SELECT task_id, arg_min(usage_id, (created_at, usage_id)) AS usage_id, arg_min(running_tokens, (created_at, usage_id)) AS running_tokens FROM r WHERE running_tokens > {BUDGET} GROUP BY task_id""",
)
def st7_budget_guard_stream(spark, sf_dir):
    """Budget breach emitted once per task by a stateful stream (equals O12)."""
    return _replayed(spark, sf_dir, "st7", _by_time(), lambda t, delay, end: ST.budget_guard_stream(v_tok(t), BUDGET, delay, end))


@query(
    "st8_retention_stream",
    f"""WITH t AS (SELECT task_id, arg_max(status, ts) AS status, max(ts) AS last_ts FROM v_log GROUP BY task_id)
SELECT task_id, CAST(floor(epoch_us(last_ts) / 1000) AS BIGINT) AS last_event_ms, status FROM t
WHERE status IN ('succeeded', 'failed', 'cancelled') AND last_ts + INTERVAL {RETENTION_DAYS * 24} HOUR < (SELECT max(ts) FROM events)""",
)
def st8_retention_stream(spark, sf_dir):
    """Finished tasks forgotten by watermark timeout (1 day after last event)."""
    # the mark stands where the watermark reaches the newest event
    return _replayed(spark, sf_dir, "st8", _by_time(), lambda t, delay, end: ST.retention_stream(v_log(t), RETENTION_DAYS, delay, end), 0)
