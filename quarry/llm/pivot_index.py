"""Exact top-k inner products through a pivot-distance index.

Every vector x gets one more component ``sqrt(M^2 - |x|^2)`` (M: the largest
norm), every query a zero; then larger inner products are smaller distances
and the triangle inequality holds.  A vector is keyed by its nearest pivot and
the distance to it.  Rows sorted by that key are cut into blocks, the annuli
[lo, hi] of a pivot.  A query first scores the annuli nearest to its own
distance from its own pivot, which bounds its k-th best distance; then only
annuli are visited whose bound ``max(d - hi, lo - d, 0)`` does not exceed it.
Scores are exact integers, and bounds are widened by a relative rounding
margin, so the result equals brute force.

Pivots are ``PIVOTS`` rows with the smallest hash: a bounded sample, which
affects speed only.  Vectors that are null, or hold null or non-finite
components, take no part; vectors of other lengths than a query's are not its
candidates; rows without an id take no part.  Ties go to the smaller vec_id;
repeated rows count as often as they occur, but never under their own id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import freeze

PIVOTS = 64  # for each vector length
BLOCK = 512  # vectors of an annulus
QUERIES = 256  # queries of a block
_MARGIN = 1e-6


def integer_vectors(table: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, dim, v (array<double> of floor(scale * x)) of usable rows."""
    limit = F.lit(float("inf"))
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < limit))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    return table.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & usable).select(
        "vec_id", F.size("embedding").alias("dim"), v.alias("v")
    )


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column])


def _by_dim(b: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
    yield from b.groupby("dim", sort=True)


def _blocks(rows: DataFrame, order: list[str], size: int, extra: str) -> DataFrame:
    """Rows in order, cut into blocks of equal (dim, pivot): matrices as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (dim, pivot), g in b.groupby(["dim", "pivot"], sort=False):
                for at in range(0, len(g), size):
                    p = g.iloc[at : at + size]
                    yield pd.DataFrame(
                        {
                            "dim": [dim],
                            "pivot": [pivot],
                            "lo": [p["dist"].min()],
                            "hi": [p["dist"].max()],
                            "ids": [p["vec_id"].to_numpy(np.int64).tobytes()],
                            "m": [_matrix(p["v"]).astype("<f8").tobytes()],
                            "tau": [p[extra].to_numpy(np.float64).tobytes()] if extra else [b""],
                        }
                    )

    made = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(
        run, "dim int, pivot int, lo double, hi double, ids binary, m binary, tau binary"
    )
    return made.withColumn("block", F.monotonically_increasing_id())


def _scores(pairs: DataFrame, k: int) -> DataFrame:
    """Best k of every query within each (query block, annulus)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                q, x = (np.frombuffer(m, "<f8").reshape(-1, r.dim) if r.dim else np.zeros((len(i) // 8, 0)) for m, i in ((r.qm, r.qids), (r.m, r.ids)))
                qi, xi = np.frombuffer(r.qids, np.int64), np.frombuffer(r.ids, np.int64)
                s = q @ x.T
                s[qi[:, None] == xi[None, :]] = -np.inf
                if len(xi) > k:
                    bar = -np.partition(-s, k - 1, axis=1)[:, k - 1]
                else:
                    bar = s.min(axis=1)
                at, to = np.nonzero((s >= bar[:, None]) & np.isfinite(s))
                best = pd.DataFrame({"query_id": qi[at], "vec_id": xi[to], "score": s[at, to].astype(np.int64)})
                best = best.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
                yield best.groupby("query_id", sort=False).head(k)

    return pairs.select("dim", "qids", "qm", "ids", "m").mapInPandas(run, "query_id long, vec_id long, score long")


def top_k(table: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of ``table`` for each row of
    ``queries`` (both vec_id, dim, v)."""
    table = freeze(table, "index-vectors")
    queries = freeze(queries.dropDuplicates(["vec_id"]), "index-queries")
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    top = {r["dim"]: float(r["m"]) for r in table.groupBy("dim").agg(F.max(norm2).alias("m")).collect()}  # one row a vector length
    by_hash = Window.partitionBy("dim").orderBy(F.xxhash64("vec_id"), "vec_id")
    sample = table.where(F.col("dim") >= 0).withColumn("_r", F.row_number().over(by_hash)).where(F.col("_r") <= PIVOTS)
    pivots: dict[int, np.ndarray] = {}
    for dim, rows in pd.DataFrame([(r["dim"], r["v"]) for r in sample.select("dim", "v").collect()], columns=["dim", "v"]).groupby("dim"):
        m = _matrix(rows["v"])
        pivots[int(dim)] = np.hstack([m, np.sqrt(np.maximum(top[int(dim)] - (m * m).sum(axis=1, keepdims=True), 0))])

    def keyed(is_query: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for dim, g in _by_dim(b):
                    if int(dim) not in pivots:
                        continue
                    m = _matrix(g["v"])
                    n2 = (m * m).sum(axis=1, keepdims=True)
                    full = np.hstack([m, np.zeros_like(n2) if is_query else np.sqrt(np.maximum(top[int(dim)] - n2, 0))])
                    p = pivots[int(dim)]
                    d2 = (full * full).sum(axis=1, keepdims=True) - 2 * full @ p.T + (p * p).sum(axis=1)
                    d = np.sqrt(np.maximum(d2, 0))
                    near = d.argmin(axis=1)
                    out = g[["vec_id", "dim", "v"]].assign(pivot=near.astype(np.int32), dist=d[np.arange(len(g)), near])
                    if is_query:
                        out["dists"] = list(d)
                        out["n2"] = n2[:, 0]
                    yield out

        return run

    base = "vec_id long, dim int, v array<double>, pivot int, dist double"
    index = freeze(_blocks(table.mapInPandas(keyed(False), base), ["dim", "pivot", "dist", "vec_id"], BLOCK, ""), "index-annuli")
    asked = freeze(queries.mapInPandas(keyed(True), base + ", dists array<double>, n2 double"), "index-asked")
    rings = index.select("dim", "pivot", "lo", "hi", "block")  # one row per BLOCK vectors
    # the annulus of the own pivot, then of any, that lies nearest; two of them give k candidates
    reach = asked.select("vec_id", "dim", "n2", F.posexplode("dists").alias("pivot", "d")).join(rings, ["dim", "pivot"])
    bound = F.greatest(F.col("d") - F.col("hi"), F.col("lo") - F.col("d"), F.lit(0.0))
    reach = freeze(reach.select("vec_id", "dim", "n2", "block", bound.alias("bound"), F.col("d").alias("_d")), "index-reach")
    near = reach.groupBy("vec_id").agg(F.min_by("block", F.struct("bound", "_d", "block")).alias("block"))
    qvecs = asked.select("vec_id", "dim", "pivot", "dist", "v")

    def scored(visits: DataFrame) -> DataFrame:
        """Visits (vec_id, block) -> best k of each, in blocks of queries."""
        v = visits.join(qvecs, "vec_id").select("vec_id", "dim", F.col("block").alias("pivot_block"), "v")
        salt = F.pmod(F.xxhash64("vec_id"), F.greatest(F.lit(1), F.ceil(F.lit(queries_n) / QUERIES)))
        grouped = v.groupBy("pivot_block", "dim", salt.alias("_s")).agg(F.collect_list(F.struct("vec_id", "v")).alias("q"))

        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = [
                    (
                        r.pivot_block,
                        np.array([x["vec_id"] for x in r.q], np.int64).tobytes(),
                        np.concatenate([np.asarray(x["v"], np.float64) for x in r.q]).astype("<f8").tobytes(),
                    )
                    for r in b.itertuples(index=False)
                ]
                yield pd.DataFrame(out, columns=["block", "qids", "qm"])

        packed = grouped.mapInPandas(pack, "block long, qids binary, qm binary")
        return _scores(packed.join(index.select("block", "dim", "ids", "m"), "block"), k)

    queries_n = asked.count()
    first = freeze(scored(near), "index-first")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    kth = first.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("_kth"))
    # distance^2 of a score: |q|^2 + M^2 - 2 score; no k-th yet: unbounded
    largest = F.lit(None).cast("double")
    for dim, m in top.items():
        largest = F.when(F.col("dim") == dim, F.lit(m)).otherwise(largest)
    far2 = F.col("n2") + largest - 2 * F.col("_kth")
    limit = F.sqrt(F.greatest(far2, F.lit(0.0))) * (1 + _MARGIN) + _MARGIN * (1 + F.sqrt(largest))
    rest = reach.join(near.withColumn("_done", F.lit(True)), ["vec_id", "block"], "left").where(F.col("_done").isNull()).join(kth, "vec_id", "left")
    rest = rest.where(F.col("_kth").isNull() | (F.col("bound") <= limit)).select("vec_id", "block")
    both = first.unionByName(scored(rest))
    best = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
