"""Kneser-Ney classifier against a plain implementation."""

import math
from collections import Counter, defaultdict
from types import SimpleNamespace

import pandas as pd
import pytest
from docs_fixture import docs, none, rows

from quarry.llm import kneser_ney as kn
from quarry.llm import queries

SF = "/root/testdata/sf0.001"
LABELS = "doc_id long, quality int, toxic int"


def grams(text):
    s = "\0\0" + text + "\0"
    return [s[i : i + 3] for i in range(len(s) - 2)] if text else []


class Plain:
    """One language's model."""

    def __init__(self, trusted, every):
        tri = Counter(g for t in trusted for g in grams(t))
        bi = Counter(g[1:] for g in tri)
        uni = Counter(g[1:] for g in bi)
        self.v = len({g[2] for t in every for g in grams(t)})
        self.levels = [(c, self.discounts(c), self.contexts(c)) for c in (tri, bi, uni)]

    @staticmethod
    def discounts(c):
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
        return [min(max(i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5, 0.01), i - 0.01) for i in (1, 2, 3)]

    def contexts(self, c):
        d = self.discounts(c)
        total, freed = defaultdict(int), defaultdict(float)
        for g, n in c.items():
            total[g[:-1]] += n
            freed[g[:-1]] += d[min(n, 3) - 1]
        return {x: (total[x], freed[x] / total[x]) for x in total}

    def p(self, g):
        out = 1 / self.v
        for k in (2, 1, 0):
            c, d, ctx = self.levels[k]
            h = g[k:]
            if h[:-1] in ctx:
                total, gamma = ctx[h[:-1]]
                n = c.get(h, 0)
                out = max(n - (d[min(n, 3) - 1] if n else 0), 0) / total + gamma * out
        return out


def check(got, table, good):
    by = defaultdict(list)
    for doc, text, lang in table:
        by[lang].append((doc, text or ""))
    want = defaultdict(list)
    for lang, ts in by.items():
        trusted = [t for d, t in ts if d in good and t]
        model = Plain(trusted, [t for _, t in ts]) if trusted else None
        memo = {}
        for d, t in ts:
            gs = grams(t)
            lp = None
            if gs and model:
                lp = sum(memo.setdefault(g, math.log(model.p(g))) for g in gs) / len(gs)
            want[d].append((lang, len(gs), None if lp is None else math.exp(-lp)))
    assert len(got) == len(table)
    for r in got:
        assert any(
            r["lang"] == lang and r["n_grams"] == n and (r["perplexity"] is None if p is None else r["perplexity"] == pytest.approx(p, rel=1e-9))
            for lang, n, p in want[r["doc_id"]]
        ), r
        assert r["keep"] == (
            r["n_grams"] > 0
            and (
                r["perplexity"] is None
                or r["low"] is None
                or (r["low"] <= r["perplexity"] <= r["high"] and (r["least_variety"] is None or r["variety"] >= r["least_variety"]))
            )
        )


def test_fixture(spark):
    labels = spark.createDataFrame([(36, 1, 0), (39, 1, 0), (42, 0, 0), (45, 1, None), (45, 1, 0), (None, 1, 0), (9999, 1, 0)], LABELS)
    got = kn.classify(docs(spark), labels).collect()
    check(got, [(r[0], r[1], r[2]) for r in rows()], {36, 39, 45})


def test_no_model_and_no_rows(spark):
    labels = spark.createDataFrame([], LABELS)
    got = kn.classify(docs(spark), labels).collect()
    assert len(got) == len(rows()) and all(r["keep"] == bool(r["n_grams"]) for r in got)
    assert kn.classify(none(spark), labels).count() == 0


def test_probabilities_sum_to_one(spark):
    labels = spark.createDataFrame([(1, 1, 0)], LABELS)
    text = "abca bcab cab a b c " * 5
    df = spark.createDataFrame([(1, text, "en"), (2, "cbacbx", "en")], "doc_id long, text string, lang string")
    marked = kn.trusted_docs(df, labels)
    grams_ = kn.count_grams(marked)
    alphabet = sorted({c for c in text + "cbacbx\0"})
    some = [("+en", sum(ord(c) << (21 * (2 - i)) for i, c in enumerate("ab" + c)), 1, 0) for c in alphabet]
    extra = spark.createDataFrame(some, "lang string, gram long, n long, c long")
    from pyspark.sql import functions as F

    whole = grams_.unionByName(extra).groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    scored = {r["gram"]: r["logp"] for r in kn.score_grams(whole).collect()}
    assert sum(math.exp(scored[g]) for _, g, _, _ in some) == pytest.approx(1.0)


def test_query(spark):
    table = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r["quality"] == 1}
    check(queries.QUERIES["op1_kneser_ney_quality"](spark, SF).collect(), table, labels)


def test_held_out_junk(spark):
    """Labelled rows that the model never saw: junk goes, clean text stays."""
    sf = "/root/testdata/sf0.01"
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    seen = labels.where("doc_id % 5 != 0")
    got = kn.classify(table, seen).join(labels.where("doc_id % 5 = 0"), "doc_id").collect()
    clean = [r["keep"] for r in got if r["quality"] == 1]
    junk = [r["keep"] for r in got if r["quality"] == 0]
    assert sum(clean) >= 0.93 * len(clean) and sum(junk) <= 0.3 * len(junk)


def test_word_repeats_in_rare_sizes_and_languages(spark):
    """Junk that mostly repeats the word before, in sizes with few trusted
    documents or none and in a language with few.  A language with none is kept,
    but its junk lies below the least variety."""
    sf = "/root/testdata/sf0.01"
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    real = [(r["doc_id"], r["text"], r["lang"]) for r in table.select("doc_id", "text", "lang").collect()]
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1}
    junk = [(f"{w} " * n, lang) for w, lang in (("For", "en"), ("Haus", "de"), ("zu", "rare"), ("na", "none")) for n in (200, 4000, 200_000)]
    extra = [(10**6 + i, t, lang) for i, (t, lang) in enumerate(junk)]
    clean = [(t, "rare" if i < 4 else "none") for i, (d, t, lang) in enumerate(r for r in real if r[0] in good and r[2] == "es")]
    extra += [(2 * 10**6 + i, t, lang) for i, (t, lang) in enumerate(clean)]
    more = spark.createDataFrame([(2 * 10**6 + i, 1, 0) for i in range(4)], LABELS)
    df = spark.createDataFrame(real + extra, "doc_id long, text string, lang string").repartition(8)
    got = kn.classify(df, labels.select("doc_id", "quality", "toxic").unionByName(more)).collect()
    assert all(r["least_variety"] is not None for r in got)
    low = {r["doc_id"]: r["variety"] < r["least_variety"] for r in got}
    repeats = [d for d, t, _ in real if len(w := t.split()) > 20 and sum(a == b for a, b in zip(w, w[1:])) > len(w) / 2]
    assert len(repeats) >= 15 and all(low[d] for d in repeats)
    assert all(low[10**6 + i] for i in range(len(junk)))
    assert not any(r["keep"] for r in got if 10**6 <= r["doc_id"] < 2 * 10**6 and r["lang"] != "none")
    assert sum(low[d] for d in good) <= 0.01 * len(good) and sum(low[2 * 10**6 + i] for i in range(len(clean))) <= 1


class Steps:
    """Stands for a table: keeps the function that runs over its batches."""

    def select(self, *_):
        return self

    def mapInPandas(self, run, _):
        self.run = run
        raise StopIteration


def test_places_are_held_in_steps(monkeypatch):
    """No more places at once than a step has, and the same rows as in one step."""
    table = pd.DataFrame({"lang": "+en", "doc_id": range(50), "text": [f"text {i} " * 30 + "\u00e9" * i for i in range(50)], "trusted": [i % 3 == 0 for i in range(50)]})
    table.loc[[3, 49], "text"] = [None, ""]
    monkeypatch.setattr(kn, "lean", lambda run: run)
    monkeypatch.setattr(kn, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 2)))
    seen, whole = [], kn._trigrams
    monkeypatch.setattr(kn, "_trigrams", lambda texts: seen.append(sum(map(len, texts))) or whole(texts))
    for make in (kn.count_grams, kn._sparse):
        made = []
        for step in (1 << 18, 1000):
            monkeypatch.setattr(kn, "_STEP", step)
            seen.clear()
            caught = Steps()
            with pytest.raises(StopIteration):
                make(caught)
            made.append(pd.concat(caught.run(iter([table.copy()])), ignore_index=True))
        assert len(seen) > 5 and max(seen) <= 1000
        pd.testing.assert_frame_equal(*made)
