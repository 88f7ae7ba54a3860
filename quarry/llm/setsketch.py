"""Near-duplicate detection with SetSketch registers.

A document's set holds the distinct runs of ``words`` words (A-Z lower-cased,
words are ``[^\\x20\\x09-\\x0D]+``; a shorter text is one run).  Register i is
``floor(1 - log_b(x))`` of the smallest exponential draw x of any element,
clipped to [0, LIMIT]: registers of a union are the larger ones, and equal
registers are as likely as the sets overlap.  ``ROWS`` registers form a band;
documents that share a band are candidates.  From two sketches the overlap is
estimated jointly by likelihood of (larger, smaller, equal) registers; pairs
far below the threshold are dropped and the rest is verified on full sets.

Equal sets are one class.  In each band bucket the classes are first compared
with a hub only (the member that meets most others).  Members already in one
component need no more comparison; the classes of buckets that still hold
several components are joined on their full sets by
:mod:`quarry.llm.prefix_tree`, which finds every link between different
components, so no candidate is lost and no group is paired with itself in a
shuffle.  Buckets hold sizes that the threshold lets meet: a set stands in two
neighbouring size classes of ratio 3/4.

Empty sets are linked with nothing and kept.  Rows without doc_id take part
in no link: component_id null, kept.  Different texts of one doc_id are different
sets under one name.  Repeated rows keep their rows.  An empty table gives no
rows.  A text's set is held whole by one task.  All
bands miss a pair at similarity 0.75 with odds below one in a million, pairs
above it with smaller ones; long bands keep texts apart that share a passage.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import prefix_tree
from quarry.llm.common import freeze, lean
from quarry.llm.graph import components
from quarry.llm.shingles import full_sets, shingles, text_steps

WORDS, PERCENT = 5, 75
BANDS, ROWS = 72, 6
REGISTERS = BANDS * ROWS
BASE, RATE, LIMIT = 1.001, 20.0, 65535
_ODDS = 14.0  # log odds against the threshold at which an estimate drops a pair
_ESTIMATE = 128  # registers that travel with a pair
_DRAW = np.random.Generator(np.random.PCG64(7))
_MUL = _DRAW.integers(1, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _DRAW.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)


def registers(elements: np.ndarray) -> np.ndarray:
    """Truncated, exponentially spaced minima of a non-empty set."""
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(elements), 256):
        part = elements[at : at + 256]
        low = np.minimum(low, (_MUL[:, None] * part[None, :] + _ADD[:, None]).min(axis=1))
    draw = -np.log1p(-((low >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / RATE
    return np.clip(np.floor(1 - np.log(draw) / np.log(BASE)), 0, LIMIT).astype("<u2")


def overlap_odds(more: np.ndarray, less: np.ndarray, na: np.ndarray, nb: np.ndarray, bar: float) -> np.ndarray:
    """Log odds of the best overlap below ``bar`` against the best at or above
    it, from the numbers of larger and smaller registers and the set sizes."""
    u = (na / (na + nb))[:, None]
    v = 1 - u
    top = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, 201)[None, :]
    j = np.minimum(grid, top)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = p(u - v * j), p(v - u * j)
    same = _ESTIMATE - more - less
    tiny = 1e-12
    like = (
        more[:, None] * np.log(np.maximum(up, tiny))
        + less[:, None] * np.log(np.maximum(down, tiny))
        + same[:, None] * np.log(np.maximum(1 - up - down, tiny))
    )
    good = (grid >= bar) & (grid <= top + 1e-9)
    return np.where(good, -np.inf, like).max(axis=1) - np.where(good, like, -np.inf).max(axis=1)


def sketch(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, h1, h2 (hash of the set), regs
    (null if empty)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for whole in batches:
            for b in text_steps(whole):
                out = []
                for text in b["text"]:
                    s = shingles(text if isinstance(text, str) else None, words)
                    h = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8")
                    out.append((len(s), h[0], h[1], registers(s).tobytes() if len(s) else None))
                frame = pd.DataFrame(out, columns=["n_shingles", "h1", "h2", "regs"])
                frame.insert(0, "doc_id", pd.array([None if pd.isna(x) else int(x) for x in b["doc_id"]], "Int64"))
                frame.insert(1, "th", b["th"].to_numpy())
                yield frame

    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    return rows.mapInPandas(lean(run), "doc_id long, th long, n_shingles long, h1 long, h2 long, regs binary")


def _buckets(classes: DataFrame, percent: int) -> DataFrame:
    """bucket (hash of band and size class), node, degree (members of its
    bands) for the bands that several classes share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        width = 2 * ROWS
        for whole in batches:
            for at in range(0, len(whole), 1000):
                b = whole.iloc[at : at + 1000]
                keys = [
                    xxhash.xxh3_64_intdigest(r[k * width : (k + 1) * width], seed=k) for r in b["regs"] for k in range(BANDS)
                ]
                yield pd.DataFrame(
                    {
                        "band": np.array(keys, np.uint64).astype(np.int64),
                        "node": np.repeat(b["node"].to_numpy(), BANDS),
                        "size": np.repeat(b["n_shingles"].to_numpy(), BANDS),
                    }
                )

    rows = classes.select("node", "n_shingles", "regs").mapInPandas(lean(run), "band long, node long, size long")
    shared = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    rows = freeze(rows.join(shared, "band"), "near-bands")
    degree = rows.groupBy("node").agg(F.sum("n").alias("degree"))
    step = F.floor(F.log(F.col("size").cast("double")) / float(np.log(100 / percent)))
    rows = rows.select("node", "band", F.explode(F.array(step, step + 1)).alias("_s"))
    return rows.join(degree, "node").select(F.xxhash64("band", "_s").alias("bucket"), "node", "degree")


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes allow the threshold and whose sketches do not speak
    against it."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n{x}"), F.substring("regs", 1, 2 * _ESTIMATE).alias(f"r{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x, y = (np.frombuffer(b"".join(b[c]), "<u2").reshape(-1, _ESTIMATE) for c in ("ra", "rb"))
                n = [b[c].to_numpy(np.float64) for c in ("na", "nb")]
                odds = overlap_odds((x > y).sum(axis=1), (x < y).sum(axis=1), *n, percent / 100)
                yield b.loc[odds <= _ODDS, ["a", "b"]]

    return both.mapInPandas(lean(run), "a long, b long")


def _verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Pairs that meet the threshold on full sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for x, y in zip(b["sa"], b["sb"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield b.loc[keep, ["a", "b"]]

    side = lambda x: full.select(F.col("node").alias(x), F.col("set").alias(f"s{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(lean(run), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash for every row of ``docs``."""
    rows = freeze(sketch(docs, words), "near-sketches")
    one = rows.where(F.col("regs").isNotNull() & F.col("doc_id").isNotNull()).groupBy("h1", "h2")
    named = one.agg(F.min(F.struct("doc_id", "th", "n_shingles", "regs")).alias("rep")).select("h1", "h2", "rep.*")
    classes = freeze(named.withColumn("node", F.monotonically_increasing_id()), "near-classes")  # written once, so the numbers stay
    members = freeze(_buckets(classes, percent), "near-buckets")
    # one comparison for each member of a bucket: with its hub, the member that meets most others
    hubs = members.groupBy("bucket").agg(F.max_by("node", F.struct("degree", -F.col("node"))).alias("hub"), F.count(F.lit(1)).alias("n"))
    starred = members.join(hubs.where(F.col("n") > 1), "bucket")
    pairs = starred.where(F.col("node") != F.col("hub")).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    pairs = freeze(pairs, "near-hubs")
    nodes = starred.select("node").distinct().join(classes.select("node", "doc_id", "th"), "node")
    full = full_sets(docs, freeze(nodes, "near-nodes"), words, "near-sets")
    links = freeze(_verified(_likely(pairs, classes, percent), full, percent), "near-links")
    label = components(links)
    # what the hubs leave: buckets of several components, joined on full sets
    open_ = members.select("bucket", "node").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = open_.groupBy("bucket").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.count(F.lit(1)).alias("_m"))
    mixed = mixed.where("_lo < _hi and _m > 2").select("bucket")  # two members have been compared
    left = freeze(open_.join(mixed, "bucket", "left_semi").select("node", F.col("bucket").alias("e"), F.col("component").alias("label")), "near-open")
    groups = prefix_tree.groups_of(left.select("node", "e"), full.select("node", "n"), "near")
    groups = groups.join(left.select("node", "label").distinct(), "node")
    rest = prefix_tree.join_groups(groups, full, percent, "near")
    links = links.unionByName(freeze(rest, "near-rest"))
    found = components(links).select("node", "component")
    linked = classes.join(found, "node")
    least = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = linked.join(least, "component").select("h1", "h2", "component_id")
    name = classes.select("h1", "h2", F.col("doc_id").alias("_own")).join(linked, ["h1", "h2"], "left")
    name = name.select("h1", "h2", F.coalesce("component_id", "_own").alias("_named"))
    component = F.when(F.col("regs").isNull(), F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("_named"))
    return rows.join(name, ["h1", "h2"], "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), F.col("th").alias("text_hash")
    )
