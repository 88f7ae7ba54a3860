"""Pfair mixing: bounds on every prefix, whole results."""

import random
from collections import Counter

import pytest
from docs_fixture import docs, none, rows

from quarry.llm import mixing, queries

SF = "/root/testdata/sf0.001"


def plain_schedule(parts, slots):
    """Earliest deadline first, slot by slot."""
    total, sent, out = sum(parts.values()), dict.fromkeys(sorted(parts), 0), []
    for t in range(slots):
        ready = [(-(-(n + 1) * total // parts[s]), n * total // parts[s], s) for s, n in sent.items() if n * total // parts[s] <= t]
        s = min(ready)[2]
        out.append((s, sent[s]))
        sent[s] += 1
    return out


def skewed(seed):
    rng = random.Random(seed)
    return [int(10 ** rng.uniform(0, 7)) + 1 for _ in range(40)]


@pytest.mark.parametrize("sizes", [[1], [3, 1, 2], [1 + i * i % 17 for i in range(12)], [1, 10**6], [2**27, 2**26, 1], [7] * 33, skewed(4), skewed(5), [1000, *[1] * 300]])
def test_schedule_is_edf_and_less_than_one_block_off(spark, sizes, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 64)  # many chunks, so assumed states are wrong and run again
    parts = {f"+s{i:03}": p for i, p in enumerate(sizes)}
    total, slots = sum(sizes), 2000
    got = sorted((r["slot"], r["_source"], r["q"]) for r in mixing.schedule(spark.createDataFrame(list(parts.items()), "_source string, parts long"), slots).collect())
    assert [t for t, _, _ in got] == list(range(len(got))) and len(got) >= slots
    assert [(s, q) for _, s, q in got] == plain_schedule(parts, len(got))
    sent = Counter()
    for t, s, _ in got:
        sent[s] += 1
        assert all(abs(sent[x] * total - (t + 1) * p) < total for x, p in parts.items())


def fair(got, docs_in):
    """Whole result; less than one block off the weights after every slot."""
    firsts = Counter((r["doc_id"], r["source"], r["n_chars"]) for r in got if r["epoch"] == 0)
    assert firsts == Counter(docs_in)
    slots = sorted({(r["slot"], r["source"] or "") for r in got})
    assert len({s for s, _ in slots}) == len(slots)  # one block a slot
    return slots


def test_mixture_is_whole(spark):
    want = [(r[0], r[3], len(r[1] or "")) for r in rows()]
    got = mixing.mix(docs(spark), {"web": 3, "book": 2, None: 1}, block_chars=500).collect()
    fair(got, want)
    by = Counter()
    slots = {r["slot"]: r["source"] for r in got}
    end = max(slots) + 1
    for t in range(end):
        if t in slots:
            by[slots[t]] += 1
    # blocks without a document (a long text spans several) leave empty slots; the others keep to the weights from above
    for s, p in (("web", 0.5), ("book", 1 / 3), (None, 1 / 6)):
        assert by[s] < end * p + 1


def test_default_weights_fill_every_prefix(spark):
    table = [(i, "x" * 100, f"s{i % 3 if i < 600 else 0}", ) for i in range(1000)]
    df = spark.createDataFrame(table, "doc_id long, text string, source string")
    got = mixing.mix(df, block_chars=200).collect()
    parts = {r["_source"][1:]: r["parts"] for r in mixing.target_parts(mixing.place_in_blocks(df, 200)).collect()}
    total = sum(parts.values())
    slots = fair(got, [(i, s, len(t)) for i, t, s in table])
    assert [t for t, _ in slots] == list(range(len(slots)))  # no slot is empty
    sent = Counter()
    for t, s in slots:
        sent[s] += 1
        assert all(abs(sent[x] - (t + 1) * p / total) < 1 for x, p in parts.items())


def test_order_and_edge_cases(spark):
    assert mixing.mix(none(spark)).count() == 0
    df = docs(spark)
    mixture = mixing.mix(df).cache()
    out = mixing.in_mixture_order(df, mixture)
    assert out.columns == df.columns
    assert out.count() == mixture.count()


def test_query(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = queries.QUERIES["op5_pfair_mixture"](spark, SF).collect()
    fair(got, [(r["doc_id"], r["source"], len(r["text"])) for r in table])


def test_long_tail_keeps_the_weights(spark):
    """A third of the characters in one source, the others in 600 equal ones."""
    tail, each = 600, 2
    table = [(i, "x" * 100, "hot") for i in range(tail * each // 2)] + [(10**6 + i, "x" * 100, f"s{i % tail}") for i in range(tail * each)]
    df = spark.createDataFrame(table, "doc_id long, text string, source string").repartition(4)
    # weights are exact to 2^-28
    chars = {s: sum(100 for r in table if r[2] == s) for s in {r[2] for r in table}}
    total = sum(c**mixing.TEMPER for c in chars.values())
    true = {s: c**mixing.TEMPER / total for s, c in chars.items()}
    got = mixing.mix(df, block_chars=100).collect()
    slots = fair(got, [(i, s, len(t)) for i, t, s in table])
    assert [t for t, _ in slots] == list(range(len(slots)))
    assert len(slots) < 1.05 * max(c / 100 / true[s] for s, c in chars.items()) + tail
    sent = Counter()
    for t, s in slots:
        sent[s] += 1
        if t % 37 == 0 or t == len(slots) - 1:
            assert all(abs(sent[x] - (t + 1) * w) < 1 + 1e-4 for x, w in true.items())


def test_small_and_missing_weights(spark):
    table = [(i, "x" * 100, "abcd"[min(i // 200, 3)]) for i in range(602)]  # d has two documents
    df = spark.createDataFrame(table, "doc_id long, text string, source string")
    got = mixing.mix(df, {"a": 0.6, "b": 0.399, "c": 0.001}, block_chars=10_000).collect()
    slots = fair(got, [(i, s, len(t)) for i, t, s in table])
    sent = Counter(s for _, s in slots)
    n = len(slots) - 1  # d, left out, comes once, at the end
    assert sent["d"] == 1 and slots[-1][1] == "d" and sum(r["source"] == "d" for r in got) == 2
    assert sent["c"] == 2 and abs(sent["a"] - 0.6 * n) < 1 and abs(sent["b"] - 0.399 * n) < 1
