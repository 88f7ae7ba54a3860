"""Exact quantiles by bracket and select, global ranks and running sums.

``percentile(x, p)`` in Spark keeps a value→count map per group and merges
them in one task per group: for a global aggregate or one hot key that is the
whole column on one executor.  Here a mergeable sketch of fixed size first
brackets each wanted rank between two values.  A second scan counts the values
below the bracket and keeps only those inside (a few ten-thousandths of a
group, as value and count, so ties cost one row); only these are put in order.
Nothing is sorted whole, shuffled by value or kept.  Results equal linear
interpolation (pandas ``quantile``, DuckDB ``quantile_cont``, Spark
``percentile``).  ``approx=True`` returns the sketch's own answer.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


_PINNED: list[DataFrame] = []


def _pin(df: DataFrame) -> DataFrame:
    _PINNED.append(df)
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def release_pinned() -> int:
    """Unpersist every frame pinned by the rank/quantile/sequence helpers.
    Call after the results that used them have been written or collected."""
    n = len(_PINNED)
    while _PINNED:
        _PINNED.pop().unpersist()
    return n


def range_partition_count(spark, partitions: int | None = None) -> int:
    """Partition count of the range layouts: the argument, else the session
    setting ``quarry.range.partitions``, else ``spark.sql.shuffle.partitions``.
    AQE neither coalesces nor splits an explicit count, so on a cluster size it
    to the data (about input bytes / 128 MB)."""
    if partitions:
        return int(partitions)
    return int(spark.conf.get("quarry.range.partitions", None) or spark.conf.get("spark.sql.shuffle.partitions"))


def range_partitioned(df: DataFrame, order: list[Column], partitions: int | None = None) -> DataFrame:
    """``df`` range-partitioned on ``order`` with its partition index in
    ``_pid``, persisted (memory, spilling to disk).

    Every evaluation of ``repartitionByRange`` samples its bounds again, so
    two branches of one plan that both read an unpersisted range exchange can
    see different ranges.  Persisting pins one partitioning for all branches;
    a lost block is recomputed through the same shuffle dependency (same
    partitioner), so the pinning survives executor loss.
    """
    n = range_partition_count(df.sparkSession, partitions)
    return _pin(df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()))


def prefix_sum(df: DataFrame, order: list[Column], value: Column, name: str, partitions: int | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` in ``order`` over the whole table,
    computed range-partition by range-partition plus partition offsets."""
    ranged = range_partitioned(df.withColumn("_val", value), order, partitions)
    local = ranged.withColumn(
        "_cs", F.sum("_val").over(W.partitionBy("_pid").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    )
    totals = ranged.groupBy("_pid").agg(F.sum("_val").alias("_tot"))
    offsets = totals.select(
        "_pid", F.coalesce(F.sum("_tot").over(W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_off")
    )
    out = local.join(F.broadcast(offsets), "_pid").withColumn(name, F.col("_off") + F.col("_cs"))
    return out.drop("_pid", "_val", "_cs", "_off")


def global_rank(df: DataFrame, order: list[Column], name: str, partitions: int | None = None) -> DataFrame:
    """1-based position of every row in ``order`` over the whole table.

    Rows are range-partitioned and sorted inside each partition; the position
    inside a partition comes from ``monotonically_increasing_id`` (partition
    index in the upper bits, row counter in the lower 33), so no second
    shuffle or window is needed; partition offsets come from a table with one
    row per partition (broadcast)."""
    n = range_partition_count(df.sparkSession, partitions)
    pid = F.spark_partition_id()
    numbered = _pin(
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_pid", pid)
        .withColumn("_rn", F.monotonically_increasing_id() - F.shiftleft(pid.cast("long"), 33) + 1)
    )
    sizes = numbered.groupBy("_pid").agg(F.max("_rn").alias("_cnt"))
    offsets = sizes.select(
        "_pid", F.coalesce(F.sum("_cnt").over(W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_off")
    )
    out = numbered.join(F.broadcast(offsets), "_pid").withColumn(name, F.col("_off") + F.col("_rn"))
    return out.drop("_pid", "_rn", "_off")


ACCURACY = 10_000  # of the sketch: a rank is off by one part in so many at most
_MARGIN = 3 / ACCURACY


def _bracket(value: Column, probs: list[float]) -> Column:
    """Array of two values a probability, around the wanted ranks."""
    ends = [F.lit(e) for p in probs for e in (max(0.0, p - _MARGIN), min(1.0, p + _MARGIN))]
    return F.percentile_approx(value, F.array(*ends), F.lit(ACCURACY))


def _rank(n: Column, p: float) -> tuple[Column, Column]:
    """Position among n ordered values (from 0), and the rank below it."""
    at = F.lit(float(p)) * (n - 1)
    return at, F.floor(at)


def _between(low: Column, high: Column, at: Column, rank: Column) -> Column:
    return low + (at - rank) * (high - low)


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], names: list[str] | None = None, approx: bool = False) -> DataFrame:
    """One row per key group with one column per probability (nulls and NaN of
    ``value`` ignored; a group without values has no row).  A group of any size
    is aggregated map-side twice: into its sketch, and into its counts."""
    names = names or [f"q{int(round(p * 100))}" for p in probs]
    x = F.col(value).cast("double")
    v = df.where(x.isNotNull() & ~F.isnan(x)).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], x.alias("_v"))
    ks = [f"_k{i}" for i in range(len(keys))]
    back = [F.col(a).alias(k) for a, k in zip(ks, keys)]
    if approx:
        aggs = [F.percentile_approx("_v", p, ACCURACY).alias(nm) for p, nm in zip(probs, names)]
        return v.groupBy(*ks).agg(*aggs).select(*back, *names)

    sketch = v.groupBy(*ks).agg(_bracket(F.col("_v"), probs).alias("_b"), F.count(F.lit(1)).alias("_n"))
    if ks:
        named = sketch.select(*[F.col(k).alias(f"_s{k}") for k in ks], "_b", "_n")
        both = v.join(named, [F.col(k).eqNullSafe(F.col(f"_s{k}")) for k in ks])
    else:
        both = v.crossJoin(F.broadcast(sketch))  # one row
    parts = []
    for i in range(len(probs)):
        side = F.when(F.col("_v") < F.col("_b")[2 * i], -1).when(F.col("_v") > F.col("_b")[2 * i + 1], 1).otherwise(0)
        parts.append(F.struct(F.lit(i).alias("_p"), side.alias("_side"), F.when(side == 0, F.col("_v")).alias("_in")))
    rows = both.select(*ks, "_n", "_v", F.explode(F.array(*parts)).alias("_e")).select(*ks, "_n", "_v", "_e.*")
    counted = rows.groupBy(*ks, "_p", "_side", "_in").agg(F.count(F.lit(1)).alias("_c"), F.max("_v").alias("_hi"), F.min("_v").alias("_lo"), F.max("_n").alias("_n"))
    upto = F.sum("_c").over(W.partitionBy(*ks, "_p").orderBy("_side", "_in").rowsBetween(W.unboundedPreceding, 0))
    placed = counted.withColumn("_upto", upto)

    def at_rank(rank: Column, here: Column) -> Column:
        """The value of that rank, if this row holds it: outside the bracket only its neighbours are known."""
        known = F.when(F.col("_side") == 0, F.col("_in"))
        known = known.when((F.col("_side") < 0) & (rank == F.col("_upto") - 1), F.col("_hi"))
        known = known.when((F.col("_side") > 0) & (rank == F.col("_upto") - F.col("_c")), F.col("_lo"))
        holds = here & (rank >= F.col("_upto") - F.col("_c")) & (rank < F.col("_upto"))
        return F.max(F.when(holds, known.otherwise(F.raise_error(F.lit("rank outside the sketch's bracket")).cast("double"))))

    out = []
    for i, (p, nm) in enumerate(zip(probs, names)):
        at, rank = _rank(F.col("_n"), p)
        here = F.col("_p") == i
        low, high = at_rank(rank, here), at_rank(F.ceil(at), here)
        n = F.max("_n")
        at_n, rank_n = _rank(n, p)
        out.append(_between(low, high, at_n, rank_n).alias(nm))
    return placed.groupBy(*ks).agg(*out).select(*back, *names)


def quantile_row(df: DataFrame, values: dict[str, Column], probs: list[float], approx: bool = False) -> DataFrame:
    """One row: ``_q``, an array with one array of quantiles (in ``probs`` order,
    null without values) for each of ``values`` (in their order).  Columns stay
    columns: no row is multiplied but for the few inside a bracket."""
    x = [F.when(~F.isnan(c.cast("double")), c.cast("double")).alias(f"_x{i}") for i, c in enumerate(values.values())]
    wide = df.select(*x)
    size, m = len(x), len(probs)
    if approx:
        row = wide.agg(*[F.percentile_approx(f"_x{i}", F.array(*map(F.lit, probs)), F.lit(ACCURACY)).alias(f"_a{i}") for i in range(size)])
        return row.select(F.array(*[F.col(f"_a{i}") for i in range(size)]).alias("_q"))
    sketch = wide.agg(*[_bracket(F.col(f"_x{i}"), probs).alias(f"_b{i}") for i in range(size)])
    both = wide.crossJoin(F.broadcast(sketch))  # one row
    side = lambda i, j: (F.col(f"_b{i}")[2 * j], F.col(f"_b{i}")[2 * j + 1], F.col(f"_x{i}"))
    counts, inside = [], []
    for i in range(size):
        counts.append(F.count(f"_x{i}").alias(f"_n{i}"))
        for j in range(m):
            lo, hi, v = side(i, j)
            counts += [
                F.count_if(v < lo).alias(f"_c{i}_{j}"),
                F.max(F.when(v < lo, v)).alias(f"_u{i}_{j}"),
                F.min(F.when(v > hi, v)).alias(f"_o{i}_{j}"),
            ]
            inside.append(F.when(v.between(lo, hi), F.struct(F.lit(i * m + j).alias("k"), v.alias("v"))))
    counts = both.agg(*counts)
    few = both.select(F.explode(F.filter(F.array(*inside), lambda s: s.isNotNull())).alias("_e")).select("_e.*")
    few = few.groupBy("k", "v").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(W.partitionBy("k").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    ranks = [
        F.struct(
            F.lit(i * m + j).alias("k"), F.lit(float(p)).alias("p"), F.col(f"_n{i}").alias("n"),
            F.col(f"_c{i}_{j}").alias("below"), F.col(f"_u{i}_{j}").alias("u"), F.col(f"_o{i}_{j}").alias("o"),
        )
        for i in range(size)
        for j, p in enumerate(probs)
    ]
    known = counts.select(F.inline(F.array(*ranks)))  # one row a rank, so the rest is one expression for all of them
    at = F.col("p") * (F.col("n") - 1)
    last = F.col("upto") + F.col("below")

    def holds(rank: Column) -> Column:
        return F.max(F.when((rank >= last - F.col("c")) & (rank < last), F.col("v")))

    placed = few.withColumn("upto", upto).join(F.broadcast(known), "k")
    # a bracket's ends are values of the column, so every rank of a column with values has rows here
    picked = placed.groupBy(*known.columns).agg(holds(F.floor(at)).alias("low"), holds(F.ceil(at)).alias("high"), F.max("upto").alias("held"))
    lost = F.raise_error(F.lit("rank outside the sketch's bracket")).cast("double")

    def value(found: str, r: Column) -> Column:
        inside = F.when(F.col(found).isNotNull(), F.col(found))
        return inside.when(r == F.col("below") - 1, F.col("u")).when(r == F.col("below") + F.col("held"), F.col("o")).otherwise(lost)

    done = picked.select("k", at.alias("at"), value("low", F.floor(at)).alias("_low"), value("high", F.ceil(at)).alias("_high"))
    done = done.select("k", _between(F.col("_low"), F.col("_high"), F.col("at"), F.floor("at")).alias("q"))
    found = done.agg(F.map_from_entries(F.collect_list(F.struct("k", "q"))).alias("_m"))
    return found.select(
        F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda j: F.try_element_at("_m", i * m + j))).alias("_q")
    )


def column_quantiles(df: DataFrame, columns: list[str], probs: list[float], names: list[str] | None = None, approx: bool = False) -> DataFrame:
    """One row per column: ``column`` and its quantiles (null without values)."""
    names = names or [f"q{int(round(p * 100))}" for p in probs]
    row = quantile_row(df, {c: F.col(c) for c in columns}, probs, approx)
    each = F.explode(F.arrays_zip(F.array(*map(F.lit, columns)).alias("column"), F.col("_q").alias("q"))).alias("_e")
    return row.select(each).select(F.col("_e.column").alias("column"), *[F.col("_e.q")[i].alias(n) for i, n in enumerate(names)])
