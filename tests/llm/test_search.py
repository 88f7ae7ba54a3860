"""Pivot index against brute force."""

import math

import numpy as np

from quarry.llm import pivot_index, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, rank int"


def plain(table, k=5):
    usable = {}
    out = {}
    for i, v in table:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable[i] = np.array([math.floor(256 * float(x)) for x in v], np.int64)
    for q, v in usable.items():
        if q % 50 == 0:
            best = sorted((-int(v @ w), i) for i, w in usable.items() if i != q and len(w) == len(v))[:k]
            out[q] = [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(x for xs in out.values() for x in xs)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def search(spark, table):
    v = pivot_index.integer_vectors(spark.createDataFrame([(*t, 1) for t in table], SCHEMA))
    return found(pivot_index.top_k(v, v.where("vec_id % 50 = 0")))


def test_ties_and_unusable_rows(spark):
    rng = np.random.default_rng(4)
    table = [(i, rng.normal(size=6).round(2).astype(np.float32).tolist()) for i in range(1300)]
    table += [(2000 + i, table[50][1]) for i in range(700)]  # one vector, many times
    table += [(5000, None), (5050, [1.0, None]), (5100, [float("nan")] * 6), (5150, [float("inf")] * 6), (None, [0.0] * 6), (5200, [0.0] * 6)]
    table += [(6000 + 25 * i, [float(i), -1.0]) for i in range(4)] + [(7000, [2.0] * 3)]
    assert search(spark, table) == plain([(i, None if v is None else [None if x is None else np.float32(x) for x in v]) for i, v in table])


def test_clusters_are_pruned_not_missed(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(20, 16)) * 3
    table = [(i, (centres[i % 20] + rng.normal(size=16) * 0.05).astype(np.float32).tolist()) for i in range(3000)]
    assert search(spark, table) == plain([(i, [np.float32(x) for x in v]) for i, v in table])


def test_empty(spark):
    assert search(spark, [(1, None)]) == []


def test_query(spark):
    table = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    df = queries.QUERIES["op7_pivot_top_k"](spark, SF)
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    assert found(df) == plain(table)
