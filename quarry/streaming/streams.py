"""ST1–ST8: the event log as a Structured Streaming source.

Sources are file streams over the given Parquet files; sinks lie in the shared
folder; every query has its own checkpoint, which is the reader's durable
cursor: a restart resumes after the last committed batch (ST2).  Rules that
need a key's rows in order (ST2, ST5-ST8) buffer them until the watermark has
passed and release them by event-time timers (:mod:`quarry.streaming.ordered`),
so files may come in any order; rows behind the watermark are dropped and
counted.  State per key is the rows of the last ``delay`` and a few numbers (the
limiter: at most ``limit`` times).  Every registered stream runs with
``trigger(availableNow=True)`` and is read back as a batch DataFrame.
"""

from __future__ import annotations

import collections
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.quantiles import range_partition_count
from quarry.functions.sequential import keyed_lag
from quarry.session import scratch_path
from quarry.sources.tables import Tables
from quarry.streaming.ordered import Rule, append_to_table, ordered_state, run_available_now
from quarry.streaming.upserts import UpsertTable

# Terminal event types and final statuses of a task, heartbeat period, limiter.
TERMINAL_EVENTS = ["task_completed", "task_failed", "task_cancelled"]
FINISHED = ["succeeded", "failed", "cancelled"]
HEARTBEAT_SECONDS = 15
RATE_LIMIT = 120
RATE_WINDOW_SECONDS = 60

FILES_PER_TRIGGER = 256  # files that one batch admits


# ---------------------------------------------------------------- sources --
def event_stream(spark: SparkSession, path: str, table_schema, files_per_trigger: int | None = FILES_PER_TRIGGER) -> DataFrame:
    """The table's own files as a stream; nothing is copied.  A batch admits
    ``files_per_trigger`` files (None: all), oldest first, which bounds its
    size.  The path is given as a pattern, as a plain one would have to be a
    folder."""
    path = path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"
    reader = spark.readStream.schema(table_schema)
    return (reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)).parquet(path)


class StreamTables(Tables):
    """Tables whose ``events`` is a stream over the given files, so the batch
    view builders (``v_log``, ``v_tok``) apply to the stream unchanged."""

    def __init__(self, spark: SparkSession, sf_dir: str, path: str | None = None, files_per_trigger: int | None = FILES_PER_TRIGGER):
        super().__init__(spark, sf_dir)
        self.path = path or f"{sf_dir.rstrip('/')}/events.parquet"
        self._files = files_per_trigger

    def __getattr__(self, name: str) -> DataFrame:
        if name == "events":
            return event_stream(self.spark, self.path, self.spark.read.parquet(self.path).schema, self._files)
        return super().__getattr__(name)


def micros(col: str) -> Column:
    """A time as an order."""
    return F.unix_micros(F.col(col).cast("timestamp"))


def by_id(col: str = "sequence_id") -> Column:
    """An id as an order: a millisecond an id."""
    return F.col(col) * 1000


# ---------------------------------------------------------------- ST1 ------
def event_log_append(stream: DataFrame, out: str, checkpoint: str) -> None:
    """ST1: durable ordered append of the log to a Parquet table (the order
    key is (ts, sequence id); Spark has no global auto-increment)."""
    append_to_table(stream, out, checkpoint)


# ---------------------------------------------------------------- ST2 ------
def cursor_reader(stream: DataFrame, out: str, checkpoint: str, run: int) -> None:
    """ST2: one independent reader; its checkpoint is its cursor.  Each batch
    is appended with the run number, so a restart shows what it re-read."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # one directory per batch id, overwritten: a batch replayed after a
        # failure (before its offsets were committed) replaces its own output
        batch.withColumn("run", F.lit(run)).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    run_available_now(stream, lambda w: w.foreachBatch(write), checkpoint)


def replay_until_terminal_stream(log_stream: DataFrame, after_sequence: int = 0, delay_ms: int = 0, end: DataFrame | None = None) -> DataFrame:
    """ST2 replay rule: per task, events after the cursor in sequence order,
    stopping after the first terminal event (later events are not sent; rows
    without a task are no one's).
    State per task = one flag."""

    def step(task: int, rows: dict[str, list], state: tuple) -> tuple[list[tuple], tuple]:
        if state[0]:
            return [], state
        out = []
        for q, e, s in zip(rows["sequence_id"], rows["event_type"], rows["status"]):
            out.append((task, q, e, s))
            if e in TERMINAL_EVENTS:
                return out, (True,)
        return out, (False,)

    rule = Rule("done boolean", (False,), "task_id long, sequence_id long, event_type string, status string", step)
    src = log_stream.where((F.col("sequence_id") > after_sequence) & F.col("task_id").isNotNull())
    return ordered_state(src, "task_id", by_id(), ["sequence_id", "event_type", "status"], ["sequence_id"], rule, delay_ms, end)


# ---------------------------------------------------------------- ST3/ST4 --
def upsert_to_table(agg: DataFrame, out: str, checkpoint: str, keys: list[str]) -> None:
    """Keeps an aggregate as a table: every batch upserts the groups that it
    changed (update mode).  :func:`latest_rows` reads the current rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        UpsertTable(batch.sparkSession, out, keys).apply(batch, batch_id)

    run_available_now(agg, lambda w: w.outputMode("update").foreachBatch(write), checkpoint)


def latest_rows(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The current rows of an upserted table."""
    return UpsertTable(spark, out, keys).rows()


def live_status(log_stream: DataFrame) -> DataFrame:
    """ST3: current status per task (streaming ``max_by``)."""
    return log_stream.groupBy("task_id").agg(
        F.max_by("status", "sequence_id").alias("status"), F.max("sequence_id").alias("last_sequence_id"), F.count(F.lit(1)).alias("events")
    )


def request_metrics(http_stream: DataFrame) -> DataFrame:
    """ST4: running request counters by (method, route, status)."""
    return http_stream.groupBy("method", "route", "status").agg(F.count(F.lit(1)).alias("requests"))


# ---------------------------------------------------------------- ST5 ------
LIMITER_OUT = "key long, event_id long, t double, allowed boolean, retry_after long"


def _limit_events(t: np.ndarray, accepted: list[float], limit: int, window: float) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Allowed flags and retry times of ascending times ``t``.  Only the last
    ``limit`` accepted times matter: a request is denied while the oldest of
    them is inside the window, so whole stretches are decided at once."""
    allowed = np.zeros(len(t), bool)
    retry = np.zeros(len(t), np.int64)
    opened = t - window  # a request sees the accepted times after this
    times, starts = t.tolist(), opened.tolist()
    kept = collections.deque((x for x in accepted), maxlen=limit)
    at = 0
    while at < len(times):
        if len(kept) < limit or kept[0] <= starts[at]:
            kept.append(times[at])
            allowed[at] = True
            at += 1
            continue
        # denied until the oldest leaves the window
        until = max(at + 1, int(np.searchsorted(opened, kept[0])))
        retry[at:until] = np.maximum(1, (window - (t[at:until] - kept[0])).astype(np.int64) + 1)
        at = until
    return allowed, retry, [x for x in kept if len(t) == 0 or x > starts[-1]]


def sliding_rate_limiter_stream(
    stream: DataFrame, key: str, limit: int = RATE_LIMIT, window: float = RATE_WINDOW_SECONDS, delay_ms: int = 0, end: DataFrame | None = None
) -> DataFrame:
    """ST5: per key, drop accepted times ≤ t − window; deny when ``limit``
    remain (retry after max(1, int(window − age of oldest) + 1)); denied
    requests are not recorded.  State per key = accepted times inside the
    window (≤ limit values), forgotten when the window has passed.  Event time
    replaces the wall clock."""

    def step(k: int, rows: dict[str, list], state: tuple) -> tuple[list[tuple], tuple]:
        t = np.array(rows["row_order"], np.float64) / 1e6
        allowed, retry, accepted = _limit_events(t, list(state[0]), limit, window)
        return list(zip([k] * len(t), rows["event_id"], t.tolist(), allowed.tolist(), retry.tolist())), (accepted,)

    rule = Rule("accepted array<double>", ([],), LIMITER_OUT, step, idle_us=int(window * 1e6))
    src = stream.where(F.col(key).isNotNull()).withColumn("event_id", F.col("event_id").cast("long"))
    return ordered_state(src, key, micros("ts"), ["event_id"], ["event_id"], rule, delay_ms, end)


_CHUNK_OUT = LIMITER_OUT + ", chunk int, first_key long, first_t double, last_key long, accepted array<double>"


def _limit_chunks(rows: DataFrame, known: dict[int, list[float]], limit: int, window: float) -> DataFrame:
    """Decisions of whole chunks (rows sorted by key and time within ``chunk``),
    each from the accepted times that it is ``known`` or assumed (none) to begin
    with, and one more row a chunk: its first and last key, and the accepted
    times that it leaves for the last key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk = key = first = accepted = None

        def end() -> dict:
            return {"chunk": [chunk], "first_key": [first[0]], "first_t": [first[1]], "last_key": [key], "accepted": [accepted]}

        for b in batches:
            if not len(b):
                continue
            keys, chunks, t = b["key"].to_numpy(), b["chunk"].to_numpy(), b["t"].to_numpy()
            edges = np.flatnonzero((np.diff(keys) != 0) | (np.diff(chunks) != 0)) + 1
            out, ends = [], []
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(b)]):
                if chunks[lo] != chunk:
                    if chunk is not None:
                        ends.append(end())
                    chunk, key, first = int(chunks[lo]), int(keys[lo]), (int(keys[lo]), float(t[lo]))
                    accepted = list(known.get(chunk, []))
                elif keys[lo] != key:
                    key, accepted = int(keys[lo]), []
                allowed, retry, accepted = _limit_events(t[lo:hi], accepted, limit, window)
                out.append((allowed, retry))
            made = b[["key", "event_id", "t", "chunk"]].assign(allowed=np.concatenate([a for a, _ in out]), retry_after=np.concatenate([r for _, r in out]))
            yield _whole(made)
            for e in ends:
                yield _whole(pd.DataFrame(e))
        if chunk is not None:
            yield _whole(pd.DataFrame(end()))

    return rows.mapInPandas(run, _CHUNK_OUT)


_CHUNK_TYPES = {"key": "Int64", "event_id": "Int64", "allowed": "boolean", "retry_after": "Int64", "first_key": "Int64", "last_key": "Int64"}


def _whole(part: pd.DataFrame) -> pd.DataFrame:
    """All columns of a chunk's output; what is missing is null."""
    names = [c.split()[0] for c in _CHUNK_OUT.split(", ")]
    accepted = list(part["accepted"]) if "accepted" in part else [None] * len(part)
    return part.reindex(columns=names).astype(_CHUNK_TYPES).assign(accepted=pd.Series(accepted, index=part.index, dtype=object))


def sliding_rate_limiter_batch(df: DataFrame, key: str, limit: int = RATE_LIMIT, window: float = RATE_WINDOW_SECONDS) -> DataFrame:
    """ST5 batch twin, split inside a key.  Rows are range-partitioned by (key,
    time): a partition is a chunk, and a key of any size spans as many as it
    fills.  All chunks run at once, each assuming that nothing was accepted just
    before it.  Where the chunk before really leaves other times inside the
    window, the chunk is run again from those, and so on until every chunk has
    run from the state that its predecessor leaves: a fixed point, which is the
    request-by-request rule.  A pause of a window, or a window without a denial,
    makes the two agree, so most chunks run once; the driver holds one row a
    chunk.  Rows without key or time have no decision."""
    spark = df.sparkSession
    src = df.select(F.col(key).cast("long").alias("key"), F.col("event_id").cast("long"), (micros("ts") / 1e6).alias("t"))
    order = ["key", "t", "event_id"]
    laid = src.where("key is not null and t is not null").repartitionByRange(range_partition_count(spark), *order).sortWithinPartitions(*order)
    laid = laid.withColumn("chunk", F.spark_partition_id())
    path = scratch_path(spark, "limiter")
    laid.write.parquet(f"{path}/rows")  # written once: another run of the ranges could cut elsewhere
    rows = spark.read.parquet(f"{path}/rows")
    known: dict[int, list[float]] = {}
    left: dict[int, tuple] = {}
    newest: dict[int, int] = {}
    todo = None
    for turn in itertools.count():
        some = rows if todo is None else rows.where(F.col("chunk").isin(todo))
        dealt = some.repartition("chunk").sortWithinPartitions("chunk", *order)
        _limit_chunks(dealt, known, limit, window).write.parquet(f"{path}/turns/turn={turn}")
        done = spark.read.schema(_CHUNK_OUT).parquet(f"{path}/turns/turn={turn}").where("first_key is not null")
        for r in done.select("chunk", "first_key", "first_t", "last_key", "accepted").collect():  # one row a chunk
            left[r["chunk"]] = (r["first_key"], r["first_t"], r["last_key"], list(r["accepted"]))
            newest[r["chunk"]] = turn
        todo, before = [], None
        for chunk in sorted(left):
            first_key, first_t = left[chunk][:2]
            same = before is not None and left[before][2] == first_key
            true = [x for x in left[before][3] if x > first_t - window] if same else []
            if true != known.get(chunk, []):
                known[chunk] = true
                todo.append(chunk)
            before = chunk
        if not todo:
            break
    out = spark.read.schema(_CHUNK_OUT + ", turn int").parquet(f"{path}/turns").where("first_key is null")
    if any(newest.values()):
        last = spark.createDataFrame(list(newest.items()), "chunk int, turn int")
        out = out.join(F.broadcast(last), ["chunk", "turn"])
    return out.select(*[c.split()[0] for c in LIMITER_OUT.split(", ")])


# ---------------------------------------------------------------- ST6 ------
def idle_heartbeat_batch(log: DataFrame, period: int = HEARTBEAT_SECONDS) -> DataFrame:
    """ST6 batch twin: heartbeats = Σ ⌊gap / period⌋ over the gaps after a
    non-terminal event of the task (skew-safe lag)."""
    lagged = keyed_lag(log.select("task_id", "sequence_id", "ts", "event_type"), ["task_id"], ["sequence_id"], ["ts", "event_type"])
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("prev_ts").cast("timestamp"))) / 1e6
    hb = F.when(F.col("prev_ts").isNotNull() & ~F.col("prev_event_type").isin(TERMINAL_EVENTS), F.greatest(F.floor(gap / period), F.lit(0))).otherwise(0)
    return lagged.groupBy("task_id").agg(F.sum(hb).cast("bigint").alias("heartbeats"))


def idle_heartbeat_stream(log_stream: DataFrame, period: int = HEARTBEAT_SECONDS, delay_ms: int = 0, end: DataFrame | None = None) -> DataFrame:
    """ST6 streaming: state per task = (time and type of its last event)."""

    def step(task: int, rows: dict[str, list], state: tuple) -> tuple[list[tuple], tuple]:
        owed, (before, kind) = 0, state
        for t, e in zip(rows["t"], rows["event_type"]):
            if before is not None and t is not None and kind not in TERMINAL_EVENTS:
                owed += max(0, math.floor((t - before) / 1e6 / period))
            before, kind = t, e
        return [(task, owed)], (before, kind)

    rule = Rule("last_t long, last_type string", (None, None), "task_id long, heartbeats long", step)
    src = log_stream.withColumn("t", micros("ts"))
    return ordered_state(src, "task_id", by_id(), ["sequence_id", "t", "event_type"], ["sequence_id"], rule, delay_ms, end)


# ---------------------------------------------------------------- ST7 ------
def budget_guard_stream(usage_stream: DataFrame, budget: int, delay_ms: int = 0, end: DataFrame | None = None) -> DataFrame:
    """ST7: emit once per task when its running token total passes the
    budget.  State per task = (running total, emitted)."""

    def step(task: int, rows: dict[str, list], state: tuple) -> tuple[list[tuple], tuple]:
        total, emitted = state
        out = []
        for usage, tokens in zip(rows["usage_id"], rows["tokens"]):
            total += tokens or 0
            if total > budget and not emitted:
                emitted = True
                out.append((task, usage, total))
        return out, (total, emitted)

    rule = Rule("total long, emitted boolean", (0, False), "task_id long, usage_id long, running_tokens long", step)
    src = usage_stream.withColumn("tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
    return ordered_state(src, "task_id", micros("created_at"), ["usage_id", "tokens"], ["usage_id"], rule, delay_ms, end)


# ---------------------------------------------------------------- ST8 ------
def retention_stream(log_stream: DataFrame, days: float, delay_ms: int = 0, end: DataFrame | None = None) -> DataFrame:
    """ST8: forget tasks that have been silent for ``days`` (by the watermark),
    and send them if they were finished: state per task = (last event time,
    status), dropped with the task, so state stays bounded by the tasks active
    in that time."""

    def step(task: int, rows: dict[str, list], state: tuple) -> tuple[list[tuple], tuple]:
        return [], (rows["row_order"][-1] // 1000, rows["status"][-1])

    def leave(task: int, state: tuple) -> list[tuple]:
        return [(task, *state)] if state[1] in FINISHED else []

    rule = Rule("last_ms long, status string", (None, None), "task_id long, last_event_ms long, status string", step, int(days * 86_400_000_000), leave)
    return ordered_state(log_stream, "task_id", micros("ts"), ["sequence_id", "status"], ["sequence_id"], rule, delay_ms, end)
