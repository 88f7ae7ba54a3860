"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import scratch_path

#: Ids that may be broadcast instead of shuffling the texts they select (16 MB).
BROADCAST_IDS = 2_000_000


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches; then the worker, which outlives the task and
    waits beside those of later stages, gives its free memory back."""

    @functools.wraps(run)
    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim is not None:
                trim(0)

    return whole


def freeze(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage so
    that a lost executor costs no recomputation of earlier rounds."""
    spark: SparkSession = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def whole_groups(batches: Iterator[pd.DataFrame], cols: list[str]) -> Iterator[pd.DataFrame]:
    """Batches of rows sorted by ``cols``, cut so that no group is split."""
    rest: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        last = np.ones(len(b), bool)
        for c in cols:
            last &= (b[c] == b[c].iat[-1]).to_numpy(bool)
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if not cut and rest and all(rest[-1][c].iat[-1] == b[c].iat[-1] for c in cols):
            rest.append(b)
            continue
        if cut:
            rest.append(b.iloc[:cut])
        if rest:
            yield pd.concat(rest, ignore_index=True) if len(rest) > 1 else rest[0].reset_index(drop=True)
        rest = [b.iloc[cut:]]
    if rest:
        yield pd.concat(rest, ignore_index=True)


def select_docs(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``docs`` whose ``doc_id`` is (``left_semi``) or is not (``left_anti``)
    among the materialised ``ids``.  The ids are broadcast only if their count
    is at most :data:`BROADCAST_IDS`; beyond it both sides are shuffled."""
    small = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, "doc_id", how)


def select_texts(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """node, text: one text for each row of ``reps`` (materialised: node, doc_id,
    th), found by doc_id and hash, so other texts of the id are left out and
    repeated rows count once."""
    small = reps.count() <= BROADCAST_IDS // 4
    mine = reps.select("node", F.col("doc_id").alias("_d"), F.col("th").alias("_t"))
    same = (F.col("doc_id") == F.col("_d")) & (F.xxhash64("text") == F.col("_t"))
    found = docs.select("doc_id", "text").join(F.broadcast(mine) if small else mine, same)
    return found.select("node", "text").dropDuplicates(["node"])


def id_bounds(df: DataFrame, col: str, buckets: int) -> DataFrame:
    """One row: ``_bounds``, at most ``buckets - 1`` ascending quantiles of
    ``col`` over all rows (an empty array for an empty table)."""
    shares = [i / buckets for i in range(1, buckets)]
    q = F.percentile_approx(col, F.array(*[F.lit(s) for s in shares]), F.lit(10 * buckets))
    return df.agg(F.coalesce(F.array_distinct(q), F.array().cast("array<bigint>")).alias("_bounds"))


def bucket_of(col: Column, bounds: Column, buckets: int) -> Column:
    """Number of ``bounds`` that are at most ``col`` (null: 0), by binary
    search in the array: about log2(buckets) steps a row."""
    steps = [1 << i for i in reversed(range(buckets.bit_length()))]
    search = F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda p, s: F.when((p + s <= F.size(bounds)) & (F.get(bounds, p + s - 1) <= col), p + s).otherwise(p),
    )
    return F.when(col.isNull(), F.lit(0)).otherwise(search)


def buckets_for(spark: SparkSession) -> int:
    """Buckets that spread ordered work: four per shuffle partition."""
    return max(32, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
