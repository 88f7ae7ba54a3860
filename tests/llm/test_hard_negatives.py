"""Hard negatives against a plain loop over all scores."""

import math

import numpy as np
import pytest

from quarry.llm import hard_negatives, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, dim string, score double"


def plain(table, every=100):
    rows = []
    for i, v, label in table:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            rows.append((i, (label + 1) % 10 if i % 7 == 0 else label, np.array([math.floor(256 * float(np.float32(x))) for x in v], object)))
    anchors = {}
    for i, label, v in rows:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (label, list(v))), (label, list(v)))
    out = []
    for a, (label, v) in anchors.items():
        scored = sorted((-int(sum(x * y for x, y in zip(v, w))), i, lb) for i, lb, w in rows if i != a and len(w) == len(v))
        pos = [(-s, i) for s, i, lb in scored if lb == label][:5]
        for ps, p in pos:
            good = [(-s, i) for s, i, lb in scored if lb != label and 80 * ps <= -100 * s <= 100 * ps][:5]
            out += [(a, p, r + 1, i, ps, s) for r, (s, i) in enumerate(good)]
    return sorted(out)


def mined(spark, table, every=100):
    df = spark.createDataFrame([(i, v, lb, "x", 0.5) for i, v, lb in table], SCHEMA).repartition(3)
    from pyspark.sql import functions as F

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.labelled_vectors(df, moved)
    return sorted(tuple(r) for r in hard_negatives.mine(rows, rows.where(F.col("vec_id") % every == 0)).collect())


def make(n, dim=4, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in rng.normal(size=dim).round(1).astype(np.float32)], int(rng.integers(0, 3))) for i in range(n)]


@pytest.mark.parametrize("block,chunk", [(8192, 1024), (64, 3)])
def test_ties_repeats_and_unusable_rows(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "CHUNK", chunk)
    table = make(700)
    table += [(1000 + i, table[100][1], i % 3) for i in range(300)]  # one vector, many times
    table += [table[200], table[200], (300, [1.0] * 4, 9), (201, [0.5] * 4, 1), (None, [0.0] * 4, 1)]
    table += [(2000, None, 1), (2100, [1.0, None], 1), (2200, [float("nan")] * 4, 1), (2300, [float("inf")] * 4, 1), (2400, [1.0] * 4, None)]
    table += [(2500 + 50 * i, [float(i), 1.0], i % 2) for i in range(8)] + [(2900, [0.0] * 4, 1), (3000, [2.0] * 3, 1), (3100, [], 1), (3101, [], 2)]
    got = mined(spark, table)
    assert got == plain(table) and len(got) > 50


def test_large_values_stay_exact(spark):
    rng = np.random.default_rng(3)
    table = [(i, [float(np.float32(x)) for x in rng.normal(size=3) * 3e5], i % 3) for i in range(120)]
    assert mined(spark, table, 20) == plain(table, 20)


def test_no_positive_and_empty(spark):
    assert mined(spark, [(100, [1.0], 1), (101, [1.0], 2)]) == []
    assert mined(spark, [(100, None, 1)]) == []


def test_query(spark):
    table = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    df = queries.QUERIES["op12_hard_negatives"](spark, SF)
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in df.collect()) == plain(table)
