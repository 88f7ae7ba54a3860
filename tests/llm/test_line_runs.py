"""Line dedup against a plain search for earlier copies."""

import random
import re

from docs_fixture import docs, none, rows

from quarry.llm import line_runs, queries

SF = "/root/testdata/sf0.001"
BLANK = " \t\r\x0b\x0c"


def solid(text):
    return [x for x in ((line.strip(BLANK)) for line in (text or "").split("\n")) if x]


def n_words(lines):
    return sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines)


def longest(table, least):
    """Lines of every run of at least ``least`` words that has an earlier copy,
    overlapping ones included."""
    texts = list(dict.fromkeys(table))
    lines = [solid(t) for _, t in texts]
    at = {}
    for d, ls in enumerate(lines):
        for i, x in enumerate(ls):
            at.setdefault(x, []).append((d, i))
    cut = {t: set() for t in texts}
    for d, ls in enumerate(lines):
        for i in range(len(ls)):
            best = 0
            for e, j in at[ls[i]]:
                if (e, j) >= (d, i):
                    break
                n = 0
                while i + n < len(ls) and j + n < len(lines[e]) and ls[i + n] == lines[e][j + n]:
                    n += 1
                best = max(best, n)
            if n_words(ls[i : i + best]) >= least:
                cut[texts[d]].update(range(i, i + best))
    return cut


def plain(table, least):
    """Lines to delete, for texts in document order: those of every shortest run
    of ``least`` words that has an earlier copy, unless they belong to that
    copy."""
    texts = list(dict.fromkeys(table))
    lines = [solid(t) for _, t in texts]
    places = {}
    for d, ls in enumerate(lines):
        runs = set()
        for i in range(len(ls)):
            ends = [j for j in range(i + 1, len(ls) + 1) if n_words(ls[i:j]) >= least]
            runs |= {(i, ends[0])} if ends else set()
            begins = [j for j in range(i, -1, -1) if n_words(ls[j : i + 1]) >= least]
            runs |= {(begins[0], i + 1)} if begins else set()
        for i, j in runs:
            places.setdefault(tuple(ls[i:j]), []).append((d, i))
    cut = {t: set() for t in texts}
    for run, where in places.items():
        first = min(where)
        for d, i in where:
            kept = range(first[1], first[1] + len(run)) if d == first[0] else ()
            if (d, i) != first:
                cut[texts[d]].update(k for k in range(i, i + len(run)) if k not in kept)
    most = longest(table, least)
    for t, ls in zip(texts, lines):
        assert cut[t] <= most[t]
        assert cut[t] == most[t] or len(set(ls)) < len(ls)  # only texts that repeat their own lines keep more
    return cut


def rewritten(text, cut):
    if text is None:
        return None
    no, out = 0, []
    for line in text.split("\n"):
        if line.strip(BLANK):
            if no not in cut:
                out.append(line)
            no += 1
        else:
            out.append(line)
    return "\n".join(out)


def check(got, table, least):
    want = plain(table, least)
    assert len(got) == len(table)
    for r in got:
        old = [t for t in want if t[0] == r["doc_id"] and r["text"] == rewritten(t[1], want[t]) and r["removed"] == sorted(want[t])]
        assert old, r["doc_id"]


def test_random_sequences(spark):
    rng = random.Random(2)
    pool = [" ".join(f"l{i}" for _ in range(rng.choice((1, 3, 12, 55)))) for i in range(9)]
    table = []
    for d in range(150):
        ls = [rng.choice([*pool, "", f"own {d} {rng.random()}"]) for _ in range(rng.randint(1, 40))]
        table.append((d, "\n".join(ls)))
    whole = table[3][1]
    table += [(200 + i, whole) for i in range(3)]
    df = spark.createDataFrame(table, "doc_id long, text string")
    for least in (1, 20, 50):
        got = line_runs.remove_repeated_lines(df, least).collect()
        check(got, table, least)
    assert any(r["removed"] for r in got)


def test_first_copy_stays_whole_and_words_are_words(spark):
    line = " ".join(f"w{i}" for i in range(10))
    tabs = "\t".join(f"t{i}" for i in range(120))
    few = "two" + " " * 60 + "words"
    table = [(1, "\n".join([line] * 20)), (2, f"{tabs}\nown {few}"), (3, f"{tabs}\n{few}"), (4, few)]
    df = spark.createDataFrame([(*r, 7, "x") for r in table], "doc_id long, text string, _cut int, _new string")
    got = line_runs.remove_repeated_lines(df).collect()
    check(got, table, 50)
    removed = {r["doc_id"]: r["removed"] for r in got}
    assert removed == {1: list(range(5, 20)), 2: [], 3: [0], 4: []} and {(r["_cut"], r["_new"]) for r in got} == {(7, "x")}


def test_edges(spark):
    table = [(r[0], r[1]) for r in rows() if r[0] is not None]
    df = docs(spark).where("doc_id is not null")
    out = line_runs.remove_repeated_lines(df, 20)
    assert out.columns == [*df.columns, "removed"]
    check(out.collect(), table, 20)
    assert line_runs.remove_repeated_lines(docs(spark)).count() == len(rows())
    assert line_runs.remove_repeated_lines(none(spark)).count() == 0


def test_query(spark):
    table = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    check(queries.QUERIES["op10_line_runs"](spark, SF).collect(), table, line_runs.MIN_WORDS)
