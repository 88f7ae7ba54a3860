"""Prefix-tree joins against all pairs of full sets."""

import random
import re

import numpy as np
import pytest
from docs_fixture import docs, none, rows

from quarry.llm import ngram_join, prefix_tree, queries

SF = "/root/testdata/sf0.001"


def plain(table, words=3, percent=90):
    """(n, component) of every row, comparing every pair; rows of one doc_id are
    sets under one name."""
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    sets = []
    for _, text in table:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    root = list(range(len(table)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and table[i][0] is not None and table[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                root[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(table):
        if doc is not None:
            least[top(i)] = min(doc, least.get(top(i), doc))
    return sorted(((d, len(sets[i]), None if d is None else least[top(i)]) for i, (d, _) in enumerate(table)), key=str)


def found(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def family(seed, copies, words=90, edits=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(copies):
        w = list(base)
        for p in rng.sample(range(words), rng.randint(0, edits)):
            w[p] = word()
        out.append(" ".join(w[: words - rng.randint(0, 4)]))
    return out


def test_fixture(spark):
    assert found(ngram_join.near_sets(docs(spark))) == plain([(r[0], r[1]) for r in rows()])
    assert found(ngram_join.near_sets(none(spark))) == []


def test_different_texts_of_one_id(spark):
    a, b = family(1, 0)[0], family(2, 0)[0]
    table = [(5, a), (5, b), (9, b + " end"), (11, a), (11, a), (12, "q r s t")]
    got = found(ngram_join.near_sets(spark.createDataFrame(table, "doc_id long, text string")))
    assert [(d, c) for d, _, c in got] == [(11, 5), (11, 5), (12, 12), (5, 5), (5, 5), (9, 5)]


@pytest.mark.parametrize("unit,most", [(1024, 64), (16, 64), (16, 1)])
def test_groups_in_units(spark, monkeypatch, unit, most):
    """Groups of near copies, whole, in blocks, and element by element."""
    monkeypatch.setattr(prefix_tree, "UNIT_SETS", unit)
    monkeypatch.setattr(prefix_tree, "MOST_BLOCKS", most)
    texts = family(3, 60) + family(4, 30, 200, 6) + family(5, 12, 12, 1)
    chain = family(6, 0, 200)[0].split()
    texts += [" ".join(chain[i * 4 : i * 4 + 100]) for i in range(20)]
    table = list(enumerate(texts))
    random.Random(1).shuffle(table)
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    for percent in (75, 90):
        assert found(ngram_join.near_sets(df, 3, percent)) == plain(table, 3, percent)


@pytest.mark.parametrize("percent", [75, 90])
def test_tree_equals_all_pairs(percent):
    rng = np.random.default_rng(percent)
    for trial in range(120):
        base = rng.integers(0, 1 << 62, rng.integers(1, 150)).astype(np.uint64)
        sets = []
        for _ in range(rng.integers(2, 30)):
            s = base.copy()
            k = rng.integers(0, 2 + len(s) // 5)
            s[rng.integers(0, len(s), k)] = rng.integers(0, 1 << 62, k).astype(np.uint64) if rng.random() < 0.7 else s[0]
            sets.append(np.unique(s[: max(1, len(s) - rng.integers(0, len(s) // 8 + 1))]))
        label = rng.integers(0, 30, len(sets)) if trial % 3 == 0 else np.arange(len(sets))
        side = np.zeros(len(sets), int) if trial % 2 else np.arange(len(sets)) % 2
        every = []
        for i, a in enumerate(sets):
            for j in range(i):
                common = len(np.intersect1d(a, sets[j]))
                if 100 * common >= percent * (len(a) + len(sets[j]) - common) and (side[i] != side[j] or not side.any()):
                    every.append((i, j))
        got = prefix_tree.links_of_unit(sets, label, side, percent)
        assert {(max(x), min(x)) for x in got} <= set(every)
        assert groups(label, got) == groups(label, every)


@pytest.mark.parametrize("percent", [60, 75, 90, 100])
def test_linked_sets_share_a_key(percent):
    """Every pair that the threshold links shares a key, across size bounds too."""
    rng = np.random.default_rng(percent)
    linked = 0
    for trial in range(1500):
        n = int(rng.choice(ngram_join.BOUNDS[:14])) + int(rng.integers(-1, 2)) if trial % 2 else int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 64, max(n, 1), dtype=np.uint64))
        drop = rng.integers(0, 1 + len(a) * (100 - percent) // 100)
        add = rng.integers(0, 1 + len(a) * (100 - percent) // 100)
        b = np.union1d(rng.permutation(a)[drop:], rng.integers(0, 1 << (64 if trial % 3 else 40), add, dtype=np.uint64))
        common = len(np.intersect1d(a, b))
        if 100 * common >= percent * (len(a) + len(b) - common):
            linked += 1
            assert len(np.intersect1d(ngram_join.part_keys(a, percent), ngram_join.part_keys(b, percent)))
    assert linked > 300


def test_common_elements_bring_nothing_together(spark):
    """A text's keys are shared by near copies alone: neither a passage that many
    texts have nor elements that each two of them share make rows or groups."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(4000)]
    passage = words[:60]
    table = []
    for i in range(60):
        own = [rng.choice(words) for _ in range(120)]
        for j in range(8):  # triples that a neighbour has too
            own[j * 10 : j * 10 + 3] = words[(i + j) % 60 * 3 + 100 : (i + j) % 60 * 3 + 103]
        table.append((i, " ".join(passage + own)))
    df = spark.createDataFrame(table, "doc_id long, text string")
    sets = ngram_join.keyed_sets(df).withColumnRenamed("doc_id", "node")
    assert ngram_join.shared_keys(sets).count() == 0
    assert found(ngram_join.near_sets(df)) == plain(table)


def groups(label, links):
    root = {i: i for i in range(len(label))}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    first = {}
    for i, x in enumerate(label):
        root[top(i)] = top(first.setdefault(int(x), i))
    for a, b in links:
        root[top(a)] = top(b)
    names = {}
    return [names.setdefault(top(i), i) for i in range(len(label))]


def test_query(spark):
    table = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert found(queries.QUERIES["op13_ngram_jaccard"](spark, SF)) == plain(table)
