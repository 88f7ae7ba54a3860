"""Streams over tables of many files, out of order, and with expired keys."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.session import scratch_path
from quarry.streaming import ordered
from quarry.streaming import streams as ST
from quarry.streaming.upserts import UpsertTable


def plain_limiter(rows, limit, window):
    """Request by request: (key, event_id) -> (allowed, retry after)."""
    accepted, out = {}, {}
    for key, t, event in sorted(rows):
        mine = accepted[key] = [x for x in accepted.get(key, []) if x > t - window]
        if len(mine) < limit:
            mine.append(t)
            out[key, event] = (True, 0)
        else:
            out[key, event] = (False, max(1, int(window - (t - mine[0])) + 1))
    return out


@pytest.mark.parametrize("limit,window", [(1, 10.0), (3, 60.0), (5, 7.5)])
def test_limiter_arrays_follow_the_rule(limit, window):
    rng = random.Random(3)
    rows = [("k", float(t), i) for i, t in enumerate(sorted(rng.choice((rng.randrange(300), rng.random() * 300)) for _ in range(500)))]
    want = plain_limiter(rows, limit, window)
    accepted, got = [], []
    for at in range(0, 500, 37):  # in batches, with state
        t = np.array([r[1] for r in rows[at : at + 37]])
        allowed, retry, accepted = ST._limit_events(t, accepted, limit, window)
        got += list(zip(allowed.tolist(), retry.tolist(), strict=True))
        assert len(accepted) <= limit
    assert got == [want["k", i] for _, _, i in rows]


def _events(spark, files):
    """A table of ``files`` files, in time order, with one busy key."""
    path = scratch_path(spark, "stream-test")
    df = spark.range(600).select(
        F.col("id").alias("event_id"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 11).cast("long").alias("user_id"),
        F.timestamp_seconds(1_700_000_000 + F.col("id") * 5).alias("ts"),
    )
    step = 600 // files
    for i in range(files):
        df.where((F.col("event_id") >= i * step) & (F.col("event_id") < (i + 1) * step)).write.mode("append").parquet(path)
    return path, df


def _shuffled(spark, df, files, seed=4):
    """The rows of ``df`` (event_id 0 ..) in files of neighbours, in random order."""
    path, n = scratch_path(spark, "stream-shuffled"), df.count()
    step = math.ceil(n / files)
    starts = list(range(0, n, step))
    random.Random(seed).shuffle(starts)
    for at in starts:
        df.where((F.col("event_id") >= at) & (F.col("event_id") < at + step)).coalesce(1).write.mode("append").parquet(path)
    return path


def test_limiter_over_shuffled_files_equals_the_rule(spark):
    _, df = _events(spark, 1)
    path = _shuffled(spark, df, 5)
    delay, last = ordered.log_disorder(spark.read.parquet(path), ST.micros("ts"))
    assert delay > 300_000  # files are far out of order
    out, ck = scratch_path(spark, "lim"), scratch_path(spark, "lim-ck")
    build = lambda end: ST.sliding_rate_limiter_stream(ST.event_stream(spark, path, df.schema, 1), "user_id", 3, 60.0, delay, end)
    assert ordered.replay_to_end(spark, build, out, ck, last + (delay + 2) * 1000) == 0
    got = {(r["key"], r["event_id"]): (r["allowed"], r["retry_after"]) for r in spark.read.parquet(out).collect()}
    twin = {(r["key"], r["event_id"]): (r["allowed"], r["retry_after"]) for r in ST.sliding_rate_limiter_batch(df, "user_id", 3, 60.0).collect()}
    rows = [(r["user_id"], float(r["ts"].timestamp()), r["event_id"]) for r in df.collect()]
    assert got == twin == plain_limiter(rows, 3, 60.0)


def test_late_rows_are_counted(spark):
    """With a delay shorter than the disorder, rows behind what was released are
    dropped and counted; the rest is decided in order."""
    _, df = _events(spark, 1)
    path = scratch_path(spark, "stream-late")
    for lo, hi in ((0, 200), (400, 500), (500, 600), (200, 400)):
        df.where((F.col("event_id") >= lo) & (F.col("event_id") < hi)).coalesce(1).write.mode("append").parquet(path)
    out, ck = scratch_path(spark, "late"), scratch_path(spark, "late-ck")
    build = lambda end: ST.sliding_rate_limiter_stream(ST.event_stream(spark, path, df.schema, 1), "user_id", 3, 60.0, 1000, end)
    late = ordered.replay_to_end(spark, build, out, ck, 1_700_003_100_000_000)
    kept = {r["event_id"] for r in spark.read.parquet(out).collect()}
    assert late == 200 and kept == {*range(200), *range(400, 600)}


@pytest.mark.parametrize("limit,window,gap", [(3, 60.0, 5), (1, 12.0, 5), (4, 1000.0, 1)])
def test_one_key_without_pause_is_spread_over_chunks(spark, limit, window, gap):
    df = spark.range(900).select(
        F.col("id").alias("event_id"),
        F.when(F.col("id") % 30 == 0, F.lit(None)).when(F.col("id") % 10 == 0, 1).otherwise(7).cast("long").alias("user_id"),
        F.timestamp_seconds(1_700_000_000 + F.floor(F.col("id") / 2) * gap).alias("ts"),
    )
    made = ST.sliding_rate_limiter_batch(df, "user_id", limit, window)
    got = {(r["key"], r["event_id"]): (r["allowed"], r["retry_after"]) for r in made.collect()}
    rows = [(r["user_id"], float(r["ts"].timestamp()), r["event_id"]) for r in df.where("user_id is not null").collect()]
    assert got == plain_limiter(rows, limit, window)
    chunks = spark.read.parquet(made.inputFiles()[0].split("/turns/")[0] + "/rows").where("key = 7").select("chunk").distinct()
    assert chunks.count() >= 6


def test_upserted_table_holds_the_newest_rows(spark):
    path, df = _events(spark, 3)
    out, ck = scratch_path(spark, "ups"), scratch_path(spark, "ups-ck")
    counts = ST.event_stream(spark, path, df.schema, files_per_trigger=1).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))
    ST.upsert_to_table(counts, out, ck, ["user_id"])
    got = {tuple(r) for r in ST.latest_rows(spark, out, ["user_id"]).collect()}
    assert got == {tuple(r) for r in df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last")).collect()}
    assert spark.read.parquet(f"{out}/state/*").count() >= 3


def _kv(spark, *rows):
    return spark.createDataFrame(rows, "k long, v string")


def test_upsert_table_reads_base_and_changes(spark):
    t = UpsertTable(spark, scratch_path(spark, "upsert"), ["k"])
    assert t.state() is None
    with pytest.raises(ValueError):
        t.rows()
    assert t.apply(spark.range(10).selectExpr("id AS k", "'a' AS v"), 0)
    assert t.state()["base"] == 0 and not t.state()["changes"]
    assert t.apply(_kv(spark, (1, "b"), (None, "n"), (20, None)), 1)
    assert t.apply(_kv(spark, (1, "c"), (1, "d")), 2)  # greatest row of a key wins
    assert [tuple(c) for c in t.state()["changes"]] == [(1, 3), (2, 2)]
    want = {k: "a" for k in range(10)} | {1: "d", None: "n", 20: None}
    assert dict(map(tuple, t.rows().collect())) == want
    assert t.apply(_kv(spark, (None, "m")), 3)  # more than half the base: merged
    assert t.state()["base"] == 3 and t.state()["base_rows"] == 12 and not t.state()["changes"]
    assert dict(map(tuple, t.rows().collect())) == want | {None: "m"}
    assert "Exchange" not in t.rows()._jdf.queryExecution().toString()


def test_upsert_table_replays_change_nothing(spark):
    path = scratch_path(spark, "replay")
    t = UpsertTable(spark, path, ["k"])
    t.apply(_kv(spark, (1, "a"), (2, "a"), (3, "a"), (4, "a")), 0)
    t.apply(_kv(spark, (1, "b")), 1)
    before = t.state()
    assert not t.apply(_kv(spark, (1, "other")), 1)
    assert t.state() == before and dict(map(tuple, t.rows().collect())) == {1: "b", 2: "a", 3: "a", 4: "a"}
    # a try that wrote its changes, but no state, is not seen and is overwritten
    _kv(spark, (9, "torn")).write.parquet(f"{path}/changes/2")
    assert t.rows().count() == 4
    assert t.apply(_kv(spark), 2) and t.rows().count() == 4


def test_upsert_table_work_follows_the_table_not_its_history(spark):
    t = UpsertTable(spark, scratch_path(spark, "long"), ["k"])
    for batch in range(6):
        t.apply(spark.range(4).selectExpr("id AS k", f"'{batch}' AS v"), batch)
        state = t.state()
        assert sum(c["rows"] for c in state["changes"]) <= 0.5 * state["base_rows"]
    assert {r["v"] for r in t.rows().collect()} == {"5"}


def test_rows_of_a_batch_may_come_in_any_order(spark):
    rows = [(1, s, 1_700_000_000 + s, "task_completed" if s == 40 else "step", "running") for s in range(60)]
    random.Random(1).shuffle(rows)
    path = scratch_path(spark, "order")
    df = spark.createDataFrame(rows, "task_id long, sequence_id long, t long, event_type string, status string").withColumn("ts", F.timestamp_seconds("t"))
    df.coalesce(1).write.parquet(path)
    out, ck = scratch_path(spark, "order-out"), scratch_path(spark, "order-ck")
    build = lambda end: ST.replay_until_terminal_stream(ST.event_stream(spark, path, df.schema), 5, end=end)
    ordered.replay_to_end(spark, build, out, ck, 100_000)
    assert sorted(r["sequence_id"] for r in spark.read.parquet(out).collect()) == list(range(6, 41))


def test_replay_of_a_long_log_of_shuffled_files(spark, monkeypatch):
    """30 days in shuffled files, one a batch; user 1 pauses for 20 days, user 2
    goes on after its terminal event: the registered streams equal plain rules."""
    from quarry.plans import catalog_streaming as CS
    from quarry.sources.views import Views

    rng = random.Random(9)
    kinds = ["view"] * 6 + ["click"] * 3 + ["error", "purchase"]
    n, step = 360, 7200  # two hours apart
    rows = []
    for i in range(n):
        days = i * step / 86400
        user = rng.choice((1, 2, 3, 4, 5) if not 4 < days < 24 else (2, 3, 4, 5))
        user = 6 if i % 97 == 0 else user
        kind = "purchase" if (user, i) == (1, 0) or i == n - 40 else "view" if user == 1 else rng.choice(kinds)
        rows.append((i, user, kind, float(rng.randrange(300)), 1_704_067_200 + i * step + rng.randrange(3600), "{}"))
    sf = scratch_path(spark, "sf-shuffled")
    starts = list(range(0, n, 30))
    rng.shuffle(starts)
    schema = "event_id long, user_id long, event_type string, value double, t long, props string"
    for s in starts:
        part = spark.createDataFrame(rows[s : s + 30], schema).withColumn("ts", F.timestamp_seconds("t")).drop("t")
        part.coalesce(1).write.mode("append").parquet(f"{sf}/events.parquet")
    monkeypatch.setattr(ST, "FILES_PER_TRIGGER", 1)
    v = Views(spark, sf)
    log = sorted((r["task_id"], r["sequence_id"], r["event_type"], r["status"]) for r in v.v_log.collect())
    want, done = [], set()
    for r in log:
        if r[1] > 100 and r[0] not in done:
            want.append(r)
            done |= {r[0]} if r[2] in ST.TERMINAL_EVENTS else set()
    assert sorted(tuple(r) for r in CS.st2_replay_until_terminal(spark, sf).collect()) == want
    as_set = lambda df: {tuple(r) for r in df.collect()}
    assert as_set(CS.st5_sliding_rate_limiter(spark, sf)) == as_set(CS.st5_rate_limiter_batch(spark, sf))
    assert as_set(CS.st6_idle_heartbeat_stream(spark, sf)) == as_set(CS.st6_idle_heartbeat(spark, sf))
    total, over = {}, {}
    for r in sorted(v.v_tok.collect(), key=lambda r: (r["created_at"], r["usage_id"])):
        k = r["task_id"]
        total[k] = total.get(k, 0) + r["prompt_tokens"] + r["completion_tokens"]
        if total[k] > CS.BUDGET:
            over.setdefault(k, (k, r["usage_id"], total[k]))
    assert over and as_set(CS.st7_budget_guard_stream(spark, sf)) == set(over.values())
    last = {}
    for r in v.v_log.orderBy("ts").collect():
        last[r["task_id"]] = (r["ts"], r["status"])
    end = max(t for t, _ in last.values())
    gone = {(k, st) for k, (t, st) in last.items() if st in ("succeeded", "failed") and (end - t).total_seconds() > CS.RETENTION_DAYS * 86400}
    got = CS.st8_retention_stream(spark, sf).collect()
    assert {(r["task_id"], r["status"]) for r in got} == gone and len(got) == len(gone)


def test_ordered_streams_run_after_an_upserted_one(spark):
    """A foreachBatch function may leave its batch's session the active one."""
    from pyspark.sql import SparkSession

    path, df = _events(spark, 1)
    stream = lambda: ST.event_stream(spark, path, df.schema)
    out, ck = scratch_path(spark, "first"), scratch_path(spark, "first-ck")
    ST.upsert_to_table(stream().groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), out, ck, ["user_id"])
    other = spark.newSession()
    other.createDataFrame([(1,)], "x int").count()
    assert not SparkSession.getActiveSession()._jsparkSession.equals(spark._jsparkSession)
    log = lambda: stream().select(F.col("user_id").alias("task_id"), F.col("event_id").alias("sequence_id"), "ts", F.lit("failed").alias("status"))
    out, ck = scratch_path(spark, "then"), scratch_path(spark, "then-ck")
    late = ordered.replay_to_end(spark, lambda end: ST.retention_stream(log(), 1, 3_000_000, end), out, ck, 1_700_100_000_000_000)
    assert late == 0 and spark.read.parquet(out).count() == df.select("user_id").distinct().count()
    spark.createDataFrame([(1,)], "x int").count()


class _Calls:
    """A list state in memory that counts its calls; also the handle."""

    def __init__(self):
        self.rows, self.calls, self.timers, self.made = [], 0, [], []

    def getListState(self, name, schema):  # noqa: N802
        self.made.append(_Calls())
        return self.made[-1]

    def registerTimer(self, ms):  # noqa: N802
        self.timers.append(ms)

    def appendValue(self, value):  # noqa: N802
        self.calls += 1
        self.rows.append(value)

    def put(self, values):
        self.calls += 1
        self.rows = list(values)

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def clear(self):
        self.calls += 1
        self.rows = []

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.now


def test_state_calls_do_not_grow_with_keys():
    """300 keys of a bucket, one of them null, ids beyond 2**53: a few calls in all."""
    import pandas as pd

    def step(key, rows, state):
        return [(key, q) for q in rows["q"]], (state[0] + len(rows["q"]),)

    rule = ordered.Rule("n long", (0,), "k long, q long", step, idle_us=5_000_000, leave=lambda key, state: [(key, -state[0])])
    p, handle = ordered._Ordered(rule, ["row_order", "q", "row_key"], {"row_order": "bigint", "q": "bigint", "row_key": "bigint"}, 1, ["q", "row_key"]), _Calls()
    p.init(handle)
    big = 2**53
    keys = [None, *range(big, big + 299)]
    rows = [(1_000_000 * s, str(big + 1 + s), k if k is None else str(k), False) for s in (3, 1, 2) for k in keys] + [(0, None, None, True)]
    frame = pd.DataFrame(rows, columns=["row_order", "q", "row_key", "end_mark"], dtype=object).astype({"row_order": "int64"})
    assert not list(p.handleInputRows((1,), iter([frame]), handle)) and handle.timers == [1000]
    got = []
    for handle.now in (2000, 3000, 8000, 8001):
        p.released.clear()
        for _ in range(2):  # two timers of one batch
            for out in p.handleExpiredTimer((1,), handle, None):
                got.append([tuple(r) for r in out.itertuples(index=False)])
    first, second, last = got
    assert first == [(k, big + 1 + s) for k in keys for s in (1, 2)]
    assert second == [(k, big + 4) for k in keys] and last == [(k, -3) for k in keys]
    assert handle.timers == [1000, 3000, 8001, 8001] and not any(s.rows for s in handle.made)
    assert sum(s.calls for s in handle.made) < 20


def test_replay_and_budget_with_null_keys_and_values(spark):
    """Nulls beside whole numbers: the rules see the numbers as they are."""
    path = scratch_path(spark, "nulls")
    rows = [(s, None if s % 5 == 0 else s % 3, None if s % 7 == 0 else 10, "step", "running") for s in range(1, 41)]
    df = spark.createDataFrame(rows, "usage_id long, task_id long, prompt_tokens long, event_type string, status string")
    df = df.withColumn("created_at", F.timestamp_seconds(1_700_000_000 + F.col("usage_id"))).withColumn("completion_tokens", F.lit(1).cast("long"))
    df = df.withColumn("sequence_id", F.col("usage_id"))
    df.coalesce(1).write.parquet(path)
    stream = lambda: ST.event_stream(spark, path, df.schema)
    out, ck = scratch_path(spark, "nulls-out"), scratch_path(spark, "nulls-ck")
    ordered.replay_to_end(spark, lambda end: ST.replay_until_terminal_stream(stream(), 5, 60_000, end), out, ck, 100_000_000)
    assert sorted((r["sequence_id"], r["task_id"]) for r in spark.read.parquet(out).collect()) == [r[:2] for r in rows if r[0] > 5 and r[1] is not None]
    out, ck = scratch_path(spark, "nulls-out"), scratch_path(spark, "nulls-ck")
    ordered.replay_to_end(spark, lambda end: ST.budget_guard_stream(stream(), 60, 60_000, end), out, ck, 1_700_000_900_000_000)
    want, total = {}, {}
    for s, task, tokens, *_ in rows:
        total[task] = total.get(task, 0) + (tokens + 1 if tokens else 0)
        if total[task] > 60:
            want.setdefault(task, (task, s, total[task]))
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == set(want.values()) and None in want
