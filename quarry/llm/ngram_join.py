"""N-gram Jaccard join through prefix trees.

A document's set holds the hashes of its distinct runs of ``words`` words (A-Z
lower-cased, words are ``[^\\x20\\x09-\\x0D]+``; a shorter text is one run).
Documents link when ``100 * intersection >= percent * union``.

Equal sets are one class.  Two sets of a and b elements that link differ in
``(100 - percent) * (a + b) / (100 + percent)`` elements at most.  Sets meet in
size classes (``size_classes``): the classes cut the sizes at bounds that grow by
half, and each bound has a class of its own for the sets that a link can lead
across it.  A class whose sets differ in d elements at most cuts the hash range
into d + 1 + z parts.  Of two sets that link, z + 1 parts at least are equal, so
the fullest of these is not among the z emptiest parts of either, which are left
out.  The class, the part and a hash of all its elements make a key; classes that
share a key may link.  A part holds some eight elements (at 90 percent), all of
which have to agree, so what meets are near copies at any size of the corpus, and
a common passage, or single elements that others have too, bring nothing together.
The connected groups of this relation (or, if a group would fall into more than
``prefix_tree.MOST_BLOCKS`` blocks, the classes of each key) are joined exactly by
:mod:`quarry.llm.prefix_tree`, on full sets; links found there are the result's
links.

Texts that are null, empty or without words have an empty set, linked with
nothing.  Rows without doc_id take part in no link: component_id null.  Rows of
one doc_id with different texts are different sets under one name.  Repeated
rows stay.  An empty table gives no rows.  A text's set is held whole by one
task: eight bytes a distinct run.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import prefix_tree
from quarry.llm.common import freeze, lean
from quarry.llm.graph import components
from quarry.llm.shingles import full_sets, shingles, text_steps

WORDS, PERCENT = 3, 90
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _bounds() -> np.ndarray:
    """First sizes of the size classes, each half as much again as the last."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 3 // 2 + 1)
    return np.array(out, np.int64)


BOUNDS = _bounds()


def size_classes(n: int, percent: int) -> list[tuple[int, int]]:
    """(class, d) of a set of ``n`` elements: every set that it links with shares
    one, and differs in d elements at most.  Class 2i + 1 holds the sizes from
    bound i to the next, class 2i those that a link can lead across bound i."""
    home = int(np.searchsorted(BOUNDS, n, side="right")) - 1
    most = 2 * (int(BOUNDS[home + 1]) - 1)  # elements of two sets below the next bound
    out = [(2 * home + 1, (100 - percent) * most // (100 + percent))]
    # a link leads from a to a * 100 / percent at most
    for i in np.flatnonzero((100 * n >= percent * BOUNDS) & (percent * n < 100 * BOUNDS)):
        below = int(BOUNDS[i]) - 1
        if below:
            out.append((2 * int(i), (100 - percent) * below // percent))
    return out


def part_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a sorted set, d + 1 for each of its size classes."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(s * _MUL ^ (s >> np.uint64(32)), dtype=np.uint64)])
    out = []
    for c, d in size_classes(len(s), percent):
        spare = 1 + d // 8
        parts = d + 1 + spare
        at = np.searchsorted((s >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))
        full = np.sort(np.argsort(np.diff(at), kind="stable")[spare:])  # of equal parts the first are left out
        h = (sums[at[full + 1]] - sums[at[full]]) ^ (np.uint64(c << 40) + full.astype(np.uint64)) * _MUL
        h = (h ^ (h >> np.uint64(29))) * _MUL
        out.append(h ^ (h >> np.uint64(32)))
    return np.concatenate(out)


def _set_hash(s: np.ndarray) -> np.ndarray:
    import xxhash

    return np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8")


def keyed_sets(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, th (hash of the text), n (set size), h1, h2 (hash of the set),
    keys (by which the set meets others)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for b in text_steps(whole):
                out = []
                for text in b["text"]:
                    s = shingles(text if isinstance(text, str) else None, words)
                    out.append((len(s), *_set_hash(s), part_keys(s, percent).tobytes() if len(s) else b""))
                made = pd.DataFrame(out, columns=["n", "h1", "h2", "keys"])
                made.insert(0, "doc_id", pd.array([None if pd.isna(x) else int(x) for x in b["doc_id"]], "Int64"))
                made.insert(1, "th", b["th"].to_numpy())
                yield made

    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    return rows.mapInPandas(lean(run), "doc_id long, th long, n long, h1 long, h2 long, keys binary")


def shared_keys(classes: DataFrame) -> DataFrame:
    """node, e: the keys that two classes or more have, a row for each of these."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 500):
                b = whole.iloc[at : at + 500]
                m = np.array([len(x) // 8 for x in b["keys"]], np.int64)
                yield pd.DataFrame({"node": np.repeat(b["node"].to_numpy(), m), "e": np.frombuffer(b"".join(b["keys"]), "<i8")})

    rows = classes.select("node", "keys").mapInPandas(lean(run), "node long, e long")
    one_key = Window.partitionBy("e")  # at most one row a class: near copies, held on disk if many
    return rows.select("node", "e", F.min("node").over(one_key).alias("lo"), F.max("node").over(one_key).alias("hi")).where("lo < hi").select("node", "e")


def link_classes(classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) of classes (node, n, keys, doc_id and th of a text)."""
    rows = freeze(shared_keys(classes), "ngram-keys")
    groups = freeze(prefix_tree.groups_of(rows, classes.select("node", "n"), "ngram"), "ngram-groups")
    reps = freeze(groups.select("node").distinct().join(classes.select("node", "doc_id", "th"), "node"), "ngram-reps")
    full = full_sets(docs, reps, words, "ngram-sets")
    return prefix_tree.join_groups(groups.withColumn("label", F.col("node")), full, percent, "ngram")


def near_sets(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) for
    every row of ``docs``."""
    if not 60 <= percent <= 100:
        raise ValueError("percent must lie between 60 and 100")
    rows = freeze(keyed_sets(docs, words, percent), "ngram-parts")
    one = rows.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy("h1", "h2")
    rep = F.min(F.struct("doc_id", "th", "n", "keys")).alias("rep")
    named = one.agg(rep).select("h1", "h2", "rep.*").withColumn("node", F.monotonically_increasing_id())
    classes = freeze(named, "ngram-classes")  # written once, so the numbers stay
    found = components(freeze(link_classes(classes, docs, words, percent), "ngram-links"))
    named = classes.join(found.select("node", "component"), "node")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = named.join(least, "component").select("h1", "h2", "component_id")
    name = classes.select("h1", "h2", F.col("doc_id").alias("_own")).join(linked, ["h1", "h2"], "left")
    name = name.select("h1", "h2", F.coalesce("component_id", "_own").alias("_named"))
    component = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("_named"))
    return rows.drop("keys").join(name, ["h1", "h2"], "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
