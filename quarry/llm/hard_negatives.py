"""Hard negatives by a secondary-sort shuffle.

Rows are packed into blocks of vectors, the anchors into chunks; each block
scores the chunks that are sent to it.  The first pass keeps, for each anchor,
a block's best rows of the anchor's label; the best of all blocks are the
positives.  The second pass knows them and keeps, of the rows with other
labels, a block's first ones in each positive's window.  What is kept is keyed
(anchor, score descending, id), dealt by anchor and sorted within partitions;
an iterator then reads each anchor's scores once, from the highest down, opens
a window at each positive and sends negatives until the window is full.  It
holds the open windows only, never an anchor's scores.

Scores are exact integers (products are summed as 64-bit integers where 53 bits
might not do).  Rows with a null id, label or vector, or with a null or
non-finite component, take no part; vectors of another length than the anchor's
are not its candidates.  An id with several rows is one anchor, with the
smallest (label, vector); rows count as candidates as often as they occur, but
never for the anchor of their own id.  At equal scores a positive opens its
window before negatives are read; ties go to the smaller id.  Anchors without
positives, and windows without rows, give no rows, as does an empty table.
Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import freeze

BLOCK = 8192  # vectors of a block
CHUNK = 1024  # anchors of a chunk
_STEP = 128  # anchors that are scored at once

_PACKED = "block long, dim int, ids binary, labels binary, bars binary, m binary"


def labelled_vectors(table: DataFrame, label: Column | str = "label", scale: int = 256) -> DataFrame:
    """vec_id, label, dim, v (array<double> of floor(scale * x)) of usable rows."""
    top = F.lit(float("inf"))
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < top))
    label = F.col(label) if isinstance(label, str) else label
    rows = table.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & usable)
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    return rows.select("vec_id", label.cast("long").alias("label"), F.size("embedding").alias("dim"), v.alias("v")).where("label is not null")


def _packed(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows (vec_id, label, dim, v, bars) as blocks of about ``size`` vectors of
    one length, ids ascending, vectors as bytes."""
    parts = max(1, math.ceil(rows.count() / size))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, k = TaskContext.get().partitionId(), 0
        held: list[pd.DataFrame] = []

        def records() -> Iterator[tuple]:
            for dim, g in pd.concat(held).groupby("dim", sort=True):
                g = g.sort_values("vec_id", kind="stable")
                m = np.concatenate([np.asarray(x, np.float64) for x in g["v"]]) if dim else np.zeros(0)
                bars = np.full((len(g), max(map(len, g["bars"]), default=0)), np.iinfo(np.int64).min, np.int64)
                for row, b in zip(bars, g["bars"], strict=True):
                    row[: len(b)] = b
                yield int(dim), g["vec_id"].to_numpy(np.int64).tobytes(), g["label"].to_numpy(np.int64).tobytes(), bars.tobytes(), m.astype("<f8").tobytes()

        def close() -> pd.DataFrame:
            nonlocal k
            out = []
            for r in records():
                out.append(((task << 32) + k, *r))
                k += 1
            held.clear()
            return pd.DataFrame(out, columns=["block", "dim", "ids", "labels", "bars", "m"])

        for b in batches:
            for at in range(0, len(b), size):
                held.append(b.iloc[at : at + size])
                if sum(map(len, held)) >= size:
                    yield close()
        if held:
            yield close()

    cols = ["vec_id", "label", "dim", "v", "bars"]
    return freeze(rows.select(*cols).repartition(parts).mapInPandas(run, _PACKED), name)


def _product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products: in doubles while no sum can leave 53 bits."""
    if q.size and x.size and float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] >= 2.0**53:
        return q.astype(np.int64) @ x.astype(np.int64).T
    return (q @ x.T).astype(np.int64)


def _first(s: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """Marks each row's k best scores in ``among``, ties to the earlier column."""
    low = np.iinfo(np.int64).min
    s = np.where(among, s, low)
    if s.shape[1] <= k:
        return among
    bar = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
    above = s > bar
    tied = among & (s == bar)
    return above | (tied & (np.cumsum(tied, axis=1) <= k - above.sum(axis=1, keepdims=True)))


def _kept(blocks: DataFrame, anchors: DataFrame, k: int, low: int | None, high: int = 100) -> DataFrame:
    """anchor, score, negative, id: what a block keeps of each anchor's scores.
    Without ``low`` the best of the same label, else the first others in each
    window [low, high] percent of a bar."""
    home = blocks.select("block", "dim", F.lit(0).alias("kind"), "ids", "labels", "bars", "m")
    # a chunk goes to every block of its vectors' length: the numbers meet, then the vectors
    sent = anchors.drop("block").join(blocks.select("block", "dim"), "dim")
    sent = sent.select("block", "dim", F.lit(1).alias("kind"), "ids", "labels", "bars", "m")
    both = home.unionByName(sent).repartition("block").sortWithinPartitions("block", "kind")

    def matrix(r) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:  # noqa: ANN001
        ids = np.frombuffer(r.ids, np.int64)
        return ids, np.frombuffer(r.labels, np.int64), np.frombuffer(r.bars, np.int64).reshape(len(ids), -1), np.frombuffer(r.m, "<f8").reshape(len(ids), r.dim)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        xi = xl = x = None
        for b in batches:
            for r in b.itertuples(index=False):
                if r.kind == 0:
                    xi, xl, _, x = matrix(r)
                    continue
                qi, ql, bars, q = matrix(r)
                for at in range(0, len(qi), _STEP):
                    p = slice(at, at + _STEP)
                    s = _product(q[p], x)
                    other = qi[p, None] != xi[None, :]
                    same = ql[p, None] == xl[None, :]
                    if low is None:
                        keep = _first(s, other & same, k)
                    else:
                        keep = np.zeros(s.shape, bool)
                        for j in range(bars.shape[1]):
                            bar = bars[p, j, None]
                            inside = (bar > np.iinfo(np.int64).min) & (100 * s <= high * bar) & (100 * s >= low * bar)
                            keep |= _first(s, other & ~same & inside, k)
                    row, col = np.nonzero(keep)
                    yield pd.DataFrame({"anchor": qi[p][row], "score": s[row, col], "negative": int(low is not None), "id": xi[col]})

    return both.mapInPandas(run, "anchor long, score long, negative int, id long")


def mine(
    table: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score:
    for each of an anchor's ``positives`` best rows of its label the first
    ``negatives`` rows of other labels that score ``low`` to ``high`` percent of
    it.  ``table`` and ``anchors``: vec_id, label, dim, v."""
    none = F.array().cast("array<bigint>")
    blocks = _packed(table.withColumn("bars", none), BLOCK, "mine-blocks")
    asked = anchors.groupBy("vec_id").agg(F.min(F.struct("label", "v", "dim")).alias("a")).select("vec_id", "a.*")
    asked = freeze(asked, "mine-anchors")
    near = _kept(blocks, _packed(asked.withColumn("bars", none), CHUNK, "mine-asked"), positives, None)
    best = Window.partitionBy("anchor").orderBy(F.col("score").desc(), "id")
    top = freeze(near.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= positives).drop("_r"), "mine-positives")
    bars = top.groupBy(F.col("anchor").alias("vec_id")).agg(F.array_sort(F.collect_set("score")).alias("bars"))
    opened = _packed(asked.join(bars, "vec_id"), CHUNK, "mine-windows")
    rows = top.unionByName(_kept(blocks, opened, negatives, low, high))
    keyed = rows.repartition("anchor").sortWithinPartitions("anchor", F.col("score").desc(), "negative", "id")

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchor, windows = None, []
        for b in batches:
            out = []
            for a, score, negative, i in zip(b["anchor"].tolist(), b["score"].tolist(), b["negative"].tolist(), b["id"].tolist(), strict=True):
                if a != anchor:
                    anchor, windows = a, []
                if not negative:
                    windows.append([score, i, 0])
                    continue
                for w in windows:
                    if w[2] < negatives and low * w[0] <= 100 * score <= high * w[0]:
                        w[2] += 1
                        out.append((a, w[1], w[2], i, w[0], score))
            yield pd.DataFrame(out, columns=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"], dtype="int64")

    return keyed.mapInPandas(
        stream, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    )
