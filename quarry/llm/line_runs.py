"""Line deduplication: repeated runs of lines by distributed prefix doubling.

A line's id is its rank among the lines that occur twice or more (blank lines
are skipped, other lines compared without blanks at their ends).  Suffixes of
the line-id sequences are ranked by their first 1, 2, 4, ... lines: the pair
(rank of the first half, rank of the second) is sorted and numbered, in an
order that refines the last one, and suffixes whose rank nobody shares drop
out.  A run counts from ``MIN_WORDS`` words: the suffixes that agree on the
lines that reach it form an interval of that common prefix length in suffix
order, and overlapping two ranks of a doubling level names it for any length.
The union of these intervals' lines, taken from run starts and run ends, are
the maximal repeated runs.  In document order the first copy of each stays;
the lines of later copies are deleted, but for those in which a later copy
overlaps the first.  Words are ``[^\\x20\\x09-\\x0D]+``.

Documents stay, if need be with empty text; null texts stay null.  Blank lines
stay.  Order is (doc_id, null first; hash of the text; line).  Rows with equal
doc_id and text are one document and are treated alike.  Extra columns are
passed through, whatever their names.  An empty table gives no rows.  The arrays
of one text's lines are held whole by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import freeze, lean

MIN_WORDS = 50
_KEY = ["d", "t"]
_NONE = -(1 << 63)


def _lines(docs: DataFrame) -> DataFrame:
    """d, t (document), idx (number among non-blank lines), line hashes, words."""
    blank = F.lit(" \t\r\x0b\x0c")
    solid = F.filter(F.transform(F.split("text", "\n"), lambda x: F.btrim(x, blank)), lambda x: x != "")
    rows = docs.where(F.col("text").isNotNull()).select(
        F.coalesce("doc_id", F.lit(_NONE)).alias("d"), F.xxhash64("text").alias("t"), F.posexplode(solid).alias("idx", "line")
    )
    words = F.regexp_count("line", F.lit(r"[^\x20\x09-\x0D]+"))
    return rows.select("d", "t", "idx", F.xxhash64("line").alias("ra"), F.xxhash64(F.lit(1), "line").alias("rb"), words.alias("w"))


def _ranked(pairs: DataFrame, name: str) -> DataFrame:
    """Ranks of the pairs (ra, rb) that occur twice or more, in their order:
    ranges are sorted and numbered, and the numbers frozen."""
    shared = pairs.groupBy("ra", "rb").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    ordered = shared.select("ra", "rb").repartitionByRange("ra", "rb").sortWithinPartitions("ra", "rb")
    return freeze(ordered.withColumn("rank", F.monotonically_increasing_id()), name)


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches cut so that no document is split."""
    rest = None
    for b in batches:
        if rest is not None:
            b = pd.concat([rest, b], ignore_index=True)
        if not len(b):
            continue
        d, t = b["d"].to_numpy(), b["t"].to_numpy()
        cut = int(np.flatnonzero((d != d[-1]) | (t != t[-1]))[-1]) + 1 if ((d != d[-1]) | (t != t[-1])).any() else 0
        rest = b.iloc[cut:]
        if cut:
            yield b.iloc[:cut]
    if rest is not None and len(rest):
        yield rest


def _codes(b: pd.DataFrame) -> np.ndarray:
    """Ascending (document, line) codes of sorted rows."""
    d, t = b["d"].to_numpy(), b["t"].to_numpy()
    new = np.concatenate([[False], (d[1:] != d[:-1]) | (t[1:] != t[:-1])])
    return (np.cumsum(new) << np.int64(32)) + b["idx"].to_numpy(np.int64)


def _windows(min_words: int):
    """Rows of repeated lines -> the same with ``lens``, the lengths of runs
    that start here and just reach ``min_words`` (counted from their first or
    from their last line), and ``need``, the longest in the unbroken run."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _documents(batches):
            code, w = _codes(b), b["w"].to_numpy(np.int64)
            n = len(b)
            seg = np.cumsum(np.concatenate([[True], np.diff(code) != 1]))
            cum = np.cumsum(w)
            here = np.arange(n)
            end = np.searchsorted(cum, cum - w + min_words)
            ok = end < n
            ok[ok] = seg[end[ok]] == seg[ok]
            first = np.searchsorted(cum - w, cum - min_words, side="right") - 1
            ok2 = first >= 0
            ok2[ok2] = seg[first[ok2]] == seg[ok2]
            starts = np.concatenate([here[ok], first[ok2]])
            lens = np.concatenate([end[ok] - here[ok] + 1, here[ok2] - first[ok2] + 1])
            both = np.unique(np.stack([starts, lens], axis=1), axis=0) if len(starts) else np.zeros((0, 2), np.int64)
            need = np.zeros(seg[-1] + 1, np.int64)
            np.maximum.at(need, seg[both[:, 0]], both[:, 1])
            at = np.searchsorted(both[:, 0], np.arange(n + 1))
            out = b[["d", "t", "idx", "rank"]].copy()
            out["lens"] = [both[at[i] : at[i + 1], 1].tolist() for i in range(n)]
            out["need"] = need[seg]
            yield out[out["need"] > 0]

    return run


def _level(k: int):
    """Rows of doubling level k -> windows named by two ranks (len > 0), and
    pairs for the next level (len 0)."""
    half = 1 << k

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _documents(batches):
            code, rank = _codes(b), b["rank"].to_numpy()
            lens = b["lens"].to_numpy()
            counts = np.array([len(x) for x in lens])
            start = np.repeat(np.arange(len(b)), counts)
            ln = np.concatenate(list(lens)).astype(np.int64) if counts.any() else np.zeros(0, np.int64)
            mine = (ln >= half) & (ln < 2 * half)
            start, ln = start[mine], ln[mine]

            def find(target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                p = np.minimum(np.searchsorted(code, target), len(code) - 1)  # noqa: B023
                return p, code[p] == target  # noqa: B023

            p, there = find(code[start] + ln - half)
            named = b[["d", "t", "idx", "lens", "need"]].iloc[start[there]].assign(ra=rank[start[there]], rb=rank[p[there]], len=ln[there])
            named["lens"] = [[] for _ in range(len(named))]
            go = np.flatnonzero(b["need"].to_numpy() >= 2 * half)
            p, there = find(code[go] + half)
            longer = b[["d", "t", "idx", "lens", "need"]].iloc[go[there]].assign(ra=rank[go[there]], rb=rank[p[there]], len=0)
            yield pd.concat([named, longer])[["d", "t", "idx", "lens", "need", "ra", "rb", "len"]]

    return run


def repeated_windows(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Later copies: d, t, idx, len (lines idx .. idx + len - 1 of d)."""
    lines = freeze(_lines(docs), "line-ids")
    ranks = _ranked(lines.select("d", "t", "idx", "ra", "rb"), "line-ranks")
    rows = lines.join(ranks, ["ra", "rb"]).dropDuplicates(["d", "t", "idx"]).select("d", "t", "idx", "w", "rank")
    level = rows.repartition(*_KEY).sortWithinPartitions(*_KEY, "idx").mapInPandas(
        lean(_windows(min_words)), "d long, t long, idx int, rank long, lens array<int>, need int"
    )
    level = freeze(level, "line-runs")
    later = None
    k = 0
    while True:
        out = level.repartition(*_KEY).sortWithinPartitions(*_KEY, "idx").mapInPandas(
            lean(_level(k)), "d long, t long, idx int, lens array<int>, need int, ra long, rb long, len int"
        )
        out = freeze(out, f"line-level{k}")
        named = out.where("len > 0").select("d", "t", "idx", "ra", "rb", "len")
        first = named.groupBy("len", "ra", "rb").agg(F.min(F.struct("d", "t", "idx")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        copies = named.join(first, ["len", "ra", "rb"]).where(F.struct("d", "t", "idx") > F.col("first"))
        # a copy that overlaps the first one begins behind it
        same = (F.col("d") == F.col("first.d")) & (F.col("t") == F.col("first.t"))
        begin = F.when(same, F.greatest("idx", F.col("first.idx") + F.col("len"))).otherwise(F.col("idx"))
        copies = copies.select("d", "t", begin.alias("idx"), (F.col("idx") + F.col("len") - begin).alias("len")).where("len > 0")
        later = copies if later is None else later.unionByName(copies)
        pairs = out.where("len = 0")
        ranks = _ranked(pairs, f"line-ranks{k + 1}")
        if ranks.isEmpty():
            return later
        level = freeze(pairs.join(ranks, ["ra", "rb"]).select("d", "t", "idx", "rank", "lens", "need"), f"line-next{k + 1}")
        k += 1


def remove_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with new ``text``, and ``removed``: the numbers (from 0, among
    non-blank lines) of the deleted lines, ascending; empty if none."""
    cut = repeated_windows(docs, min_words).select("d", "t", F.explode(F.sequence("idx", F.col("idx") + F.col("len") - 1)).alias("idx"))
    cut = cut.groupBy(F.col("d").alias("_d"), F.col("t").alias("_t")).agg(F.sort_array(F.collect_set("idx")).alias("_cut"))
    cut = freeze(cut, "line-cuts")
    # the table's own columns stay in a structure, so that their names cannot clash
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce("doc_id", F.lit(_NONE)).alias("_kd"), F.xxhash64("text").alias("_kt"))
    # both sides are dealt by document at every size
    joined = keyed.join(cut.hint("merge"), (F.col("_kd") == F.col("_d")) & (F.col("_kt") == F.col("_t")), "left")
    blank = F.lit(" \t\r\x0b\x0c")
    # lines with their numbers among the non-blank ones, folded once a document that loses lines
    kept = F.aggregate(
        F.split(F.col("_row.text"), "\n"),
        F.struct(F.lit(0).alias("no"), F.array().cast("array<string>").alias("out")),
        lambda a, x: F.when(F.btrim(x, blank) == "", F.struct(a["no"].alias("no"), F.concat(a["out"], F.array(x)).alias("out"))).otherwise(
            F.struct(
                (a["no"] + 1).alias("no"),
                F.when(F.array_contains(F.col("_cut"), a["no"]), a["out"]).otherwise(F.concat(a["out"], F.array(x))).alias("out"),
            )
        ),
        lambda a: a["out"],
    )
    text = F.when(F.col("_cut").isNull(), F.col("_row.text")).otherwise(F.array_join(kept, "\n"))
    cols = [text.alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns if c != "removed"]
    return joined.select(*cols, F.coalesce("_cut", F.array().cast("array<int>")).alias("removed"))
