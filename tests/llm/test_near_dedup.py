"""SetSketch near-duplicates against all pairs of full sets."""

import random
import re

import numpy as np
import pytest
from docs_fixture import docs, none, rows

from quarry.llm import graph, queries, setsketch

SF = "/root/testdata/sf0.001"


def plain(table):
    """(n, component, kept) by doc_id, comparing every pair."""
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    sets = {}
    for doc, text in table:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        sets[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    comp = {d: d for d in sets}

    def root(d):
        while comp[d] != d:
            d = comp[d]
        return d

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}


def check(got, table):
    want = plain([r for r in table if r[0] is not None])
    assert len(got) == len(table)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == want[r["doc_id"]]


def test_fixture(spark):
    check(setsketch.near_duplicates(docs(spark)).collect(), [(r[0], r[1]) for r in rows()])
    assert setsketch.near_duplicates(none(spark)).count() == 0


def test_group_of_near_copies(spark):
    """Copies of one text, each near the original but not near each other, and
    chains in which each text is near the next only."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(400)]
    table = [(500, " ".join(base))]
    for i in range(80):
        w = list(base)
        for p in rng.sample(range(80), 9):
            w[p * 5] = word()
        table.append((i, " ".join(w)))
    chain = [word() for _ in range(300)]
    for i in range(12):
        table.append((600 + i, " ".join(chain[i * 12 : i * 12 + 150])))
    check(setsketch.near_duplicates(spark.createDataFrame(table, "doc_id long, text string")).collect(), table)


def test_different_texts_of_one_id(spark):
    """(5, A), (5, B), (9, near B): 9 hangs together with 5 through B."""
    rng = random.Random(2)
    a, b = (" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)) for _ in range(2))
    table = [(5, a), (5, b), (9, b + " end"), (11, a)]
    got = setsketch.near_duplicates(spark.createDataFrame(table, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [(5, 5, True), (5, 5, True), (9, 5, False), (11, 5, False)]


@pytest.mark.parametrize("overlap", [0.5, 0.75, 0.9])
def test_registers_estimate_overlap(overlap):
    rng = np.random.default_rng(1)
    n = 2000
    common = int(2 * n * overlap / (1 + overlap))
    x = rng.integers(0, 1 << 63, 2 * n - common, dtype=np.uint64)
    a, b = np.unique(x[:n]), np.unique(x[n - common :])
    ra, rb = setsketch.registers(a), setsketch.registers(b)
    assert abs((ra == rb).mean() - overlap) < 0.1
    assert (np.maximum(ra, rb) == setsketch.registers(np.union1d(a, b))).all()  # mergeable
    x, y = ra[: setsketch._ESTIMATE].astype(int), rb[: setsketch._ESTIMATE].astype(int)
    odds = setsketch.overlap_odds(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([float(n)]), np.array([float(n)]), 0.75)
    assert odds[0] < setsketch._ODDS or overlap < 0.75


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 300), (7, 7)]
    got = dict(graph.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 0 for i in range(31)} | {100: 100, 200: 100, 300: 100}


def test_query(spark):
    table = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(queries.QUERIES["op2_setsketch_near_dedup"](spark, SF).collect(), table)
