"""Per-key sequential operators (lag, running sum) that survive a hot key.

``Window.partitionBy(key).orderBy(t)`` sends every row of one key to one
task; if one task id holds a third of the log, one executor does a third of
the work.  Here rows are range-partitioned on ``(key, order)`` — a hot key is
split over many partitions — the window runs per range partition, and the
rows at partition edges are fixed up from a per-partition summary table
(one row per partition: its size is the partition count, not the data).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.quantiles import prefix_sum, range_partitioned


def keyed_lag(df: DataFrame, keys: list[str], order: list[str], cols: list[str], prefix: str = "prev_", partitions: int | None = None) -> DataFrame:
    """Adds ``prev_<c>`` = value of ``c`` on the previous row of the same key
    (in ``order``), null on a key's first row."""
    sort = [F.col(k).asc_nulls_first() for k in keys] + [F.col(o).asc_nulls_first() for o in order]
    r = range_partitioned(df, sort, partitions)
    w = W.partitionBy("_pid").orderBy(*sort)
    local = r.select("*", *[F.lag(c).over(w).alias(f"_l_{c}") for c in keys + cols], F.row_number().over(w).alias("_rn"))
    # last row of every partition, carried to the next non-empty partition
    plain = F.struct(*[F.col(c) for c in keys + order])
    last = r.groupBy("_pid").agg(F.max_by(F.struct(*[F.col(c) for c in keys + cols]), plain).alias("_last"))
    carry = last.select(F.col("_pid"), F.lag("_last").over(W.orderBy("_pid")).alias("_carry"))
    j = local.join(F.broadcast(carry), "_pid", "left")
    out = j
    first = F.col("_rn") == 1
    same_key = F.lit(True)
    for k in keys:
        prev_k = F.when(first, F.col("_carry")[k]).otherwise(F.col(f"_l_{k}"))
        same_key = same_key & prev_k.eqNullSafe(F.col(k))
    for c in cols:
        prev_c = F.when(first, F.col("_carry")[c]).otherwise(F.col(f"_l_{c}"))
        out = out.withColumn(f"{prefix}{c}", F.when(same_key, prev_c))
    return out.drop("_pid", "_rn", "_carry", *[f"_l_{c}" for c in keys + cols])


def keyed_running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, partitions: int | None = None) -> DataFrame:
    """Adds ``name`` = running (inclusive) sum of ``value`` within each key in
    ``order``: a global prefix sum in (keys, order) minus the sum before the
    key's first row (one row per key, joined back on the key; AQE splits a
    skewed key on the large side of that join)."""
    sort = [F.col(k).asc_nulls_first() for k in keys] + [F.col(o).asc_nulls_first() for o in order]
    g = prefix_sum(df.withColumn("_v", F.coalesce(F.col(value), F.lit(0))), sort, F.col("_v"), "_gcs", partitions)
    base = g.groupBy(*keys).agg(F.min_by(F.col("_gcs") - F.col("_v"), F.struct(*[F.col(o) for o in order])).alias("_base"))
    base = base.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_base")
    cond = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    out = g.join(base, cond).drop(*[f"_k_{k}" for k in keys])
    return out.withColumn(name, F.col("_gcs") - F.col("_base")).drop("_v", "_gcs", "_base")
