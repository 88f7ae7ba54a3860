"""Set similarity joins by prefix trees, inside groups of sets.

The sets of a unit are written as sequences in one order of their elements,
most frequent first, and put into a path-compressed tree.  A set walks the tree
level by level: branches share the overlap of their common path, and a branch
is left when the overlap so far and the shorter of the two rests cannot reach
the threshold, or when all its sets already hang together with the walking one.
So the links found join all sets that reach each other, and are fewer than the
sets.

A group of any size is dealt to units of bounded size: its sets go to blocks,
and each pair of blocks is a unit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import freeze, lean, whole_groups
from quarry.llm.graph import components

UNIT_ELEMENTS, UNIT_SETS = 1 << 20, 1024  # of a block, about
MOST_BLOCKS = 64  # of a connected group
_PIECE = 32  # elements of a path that are compared before a branch can be left


def _ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + lens[i] - 1 of every i, joined."""
    ends = np.cumsum(lens)
    return np.repeat(starts - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)


class PrefixTree:
    """The tree of ascending sequences; ``order`` are the members by leaf.

    A node is the sequences lo .. hi - 1 and the elements at .. end - 1 of their
    path (``nothing`` is an element of no set); ``least`` and ``most`` are the smallest and largest set size below."""

    def __init__(self, seqs: list[np.ndarray], sizes: np.ndarray, nothing: int):
        keys = [s.astype(">u4").tobytes() for s in seqs]
        self.order = np.array(sorted(range(len(seqs)), key=keys.__getitem__), np.int64)
        seqs = [seqs[i] for i in self.order]
        self.size = sizes[self.order]
        lcp = [0]
        for a, b in zip(seqs, seqs[1:]):
            m = min(len(a), len(b))
            differ = a[:m] != b[:m]
            lcp.append(int(differ.argmax()) if differ.any() else m)
        # nodes: first sequence, depth, parent (-1: root); the open path is a stack
        lo, depth, parent, is_leaf = [], [], [], []

        def node(first: int, deep: int, leaf: bool) -> int:
            lo.append(first)
            depth.append(deep)
            parent.append(-1)
            is_leaf.append(leaf)
            return len(lo) - 1

        stack = [-1]
        for i in range(len(seqs) + 1):
            common = lcp[i] if i < len(seqs) else 0
            while stack[-1] >= 0 and (is_leaf[stack[-1]] or depth[stack[-1]] > common):
                v = stack.pop()
                above = depth[stack[-1]] if stack[-1] >= 0 else 0
                if above < common:
                    stack.append(node(lo[v], common, False))
                parent[v] = stack[-1]
            if i < len(seqs):
                stack.append(node(i, len(seqs[i]), True))
        lo, end, parent, is_leaf = np.array(lo), np.array(depth), np.array(parent), np.array(is_leaf)
        at = np.where(parent >= 0, end[parent], 0)
        # long paths are chains of pieces
        parts = np.maximum(1, -(-(end - at) // _PIECE))
        tail = np.cumsum(parts) - 1
        step = np.arange(parts.sum()) - np.repeat(tail + 1 - parts, parts)
        self.lo = np.repeat(lo, parts)
        self.at = np.repeat(at, parts) + step * _PIECE
        self.end = np.minimum(self.at + _PIECE, np.repeat(end, parts))
        self.leaf = np.zeros(len(step), bool)
        self.leaf[tail] = is_leaf
        up = np.where(step > 0, np.arange(len(step)) - 1, np.repeat(np.where(parent >= 0, tail[parent], -1), parts))
        self.kids = np.argsort(up, kind="stable")
        self.kid_at = np.searchsorted(up[self.kids], np.arange(-1, len(step) + 1))
        # extremes of the sets below, from the deepest pieces up
        self.hi, self.least, self.most = self.lo + 1, self.size[self.lo].copy(), self.size[self.lo].copy()
        self.rest = np.array([len(x) for x in seqs], np.int64)[self.lo]
        for v in np.argsort(-self.at - self.end, kind="stable"):
            # a piece of no elements below its parent is a leaf and comes first
            p = up[v]
            if p >= 0:
                self.hi[p] = max(self.hi[p], self.hi[v])
                self.least[p] = min(self.least[p], self.least[v])
                self.most[p] = max(self.most[p], self.most[v])
                self.rest[p] = max(self.rest[p], self.rest[v])
        # a piece's elements in one row, filled up with an element of no set
        lens = self.end - self.at
        flat = np.concatenate(seqs)
        first = np.cumsum([len(x) for x in seqs]) - [len(x) for x in seqs]
        self.piece = np.full((len(lens), min(_PIECE, int(lens.max()))), nothing, np.int32)
        self.piece[np.repeat(np.arange(len(lens)), lens), _ragged(np.zeros(len(lens), np.int64), lens)] = flat[_ragged(first[self.lo] + self.at, lens)]
        self.last = np.array([x[-1] if len(x) else -1 for x in seqs])[self.lo]
        inside = np.flatnonzero(lens > 0)
        self.last[inside] = self.piece[inside, lens[inside] - 1]

    def children(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Children of ``nodes``, and the number of their parent in the list."""
        a, b = self.kid_at[nodes + 1], self.kid_at[nodes + 2]
        return self.kids[_ragged(a, b - a)], np.repeat(np.arange(len(nodes)), b - a)

    def near(self, seq: np.ndarray, size: int, member: np.ndarray, percent: int, open_before: np.ndarray) -> np.ndarray:
        """Leaves whose sets meet the threshold with a set of ``size`` elements,
        ``seq`` in the unit's order; ``member`` marks them.  ``open_before[i]``
        leaves before i are still to be looked at."""
        node, overlap = self.children(np.array([-1]))[0], None
        found = []
        while len(node):
            if overlap is None:
                overlap = np.zeros(len(node), np.int64)
            ok = open_before[self.hi[node]] > open_before[self.lo[node]]
            ok &= (100 * self.most[node] >= percent * size) & (100 * size >= percent * self.least[node])
            node, overlap = node[ok], overlap[ok]
            if not len(node):
                break
            overlap = overlap + member[self.piece[node]].sum(axis=1)
            left_x = len(seq) - np.searchsorted(seq, self.last[node], side="right")
            left_y = self.rest[node] - self.end[node]
            need = -(-percent * (size + self.least[node]) // (100 + percent))
            ok = overlap + np.minimum(left_x, left_y) >= need
            node, overlap = node[ok], overlap[ok]
            leaf = self.leaf[node]
            done, o = node[leaf], overlap[leaf]
            n = self.size[self.lo[done]]
            hit = (100 * o >= percent * (size + n - o)) & (open_before[self.hi[done]] > open_before[self.lo[done]])
            found.append(self.lo[done][hit])
            node, overlap = node[~leaf], overlap[~leaf]
            node, up = self.children(node)
            overlap = overlap[up]
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def links_of_unit(sets: list[np.ndarray], label: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of members whose sets meet the threshold, enough to join what hangs
    together: members of one ``label`` do already.  With two sides, only pairs of
    different sides are looked for."""
    sizes = np.array([len(s) for s in sets], np.int64)
    two = bool((side != side[0]).any())
    if len(sets) == 2:
        common = len(np.intersect1d(*sets, assume_unique=True))
        return [(0, 1)] if label[0] != label[1] and 100 * common >= percent * (sizes.sum() - common) else []
    values, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # most frequent first; what only one set holds counts in its size alone
    rank = np.empty(len(values), np.int64)
    by = np.argsort(-count, kind="stable")
    rank[by] = np.arange(len(values))
    shared = int((count > 1).sum())
    ids, cut = rank[code], np.cumsum(sizes)[:-1]
    seqs = [np.sort(x[x < shared]) for x in np.split(ids, cut)]
    inner = np.flatnonzero(side == 0) if two else np.arange(len(sets))
    asking = np.flatnonzero(side == 1) if two else None
    tree = PrefixTree([seqs[i] for i in inner], sizes[inner], shared)
    leaf_member = inner[tree.order]
    member = np.zeros(shared + 1, bool)
    label = np.unique(label, return_inverse=True)[1]
    out = []
    for k, x in enumerate(asking if two else leaf_member):
        closed = label[leaf_member] == label[x]
        if not two:
            closed[k:] = True
        if closed.all():
            continue
        open_before = np.concatenate([[0], np.cumsum(~closed)])
        member[seqs[x]] = True
        near = leaf_member[tree.near(seqs[x], int(sizes[x]), member, percent, open_before)]
        member[seqs[x]] = False
        for y in near:
            if label[y] != label[x]:
                out.append((int(x), int(y)))
                label[label == label[y]] = label[x]
    return out


def groups_of(rows: DataFrame, sizes: DataFrame, name: str) -> DataFrame:
    """g, node: groups such that nodes that share a key are together in one.
    ``rows``: node, e (materialised); ``sizes``: node, n.  A group is a connected
    set of nodes, each in it once; one that would fall into more than
    ``MOST_BLOCKS`` blocks is given key by key instead."""
    hubs = rows.groupBy("e").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("_c")).where("_c > 1").select("e", "hub")
    star = rows.join(hubs, "e").where(F.col("node") != F.col("hub"))
    near = components(star.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    near = freeze(near.join(sizes, "node"), f"{name}-connected")
    size = F.greatest(F.sum("n") / F.lit(UNIT_ELEMENTS), F.count(F.lit(1)) / F.lit(UNIT_SETS))
    large = near.groupBy("component").agg(size.alias("_s")).where(F.col("_s") > MOST_BLOCKS).select("component")
    large = freeze(near.join(large, "component", "left_semi").select("node"), f"{name}-large")
    whole = near.join(large, "node", "left_anti").select(F.xxhash64(F.lit(0), "component").alias("g"), "node")
    each = rows.join(large, "node", "left_semi").join(hubs, "e").select(F.xxhash64(F.lit(1), "e").alias("g"), "node")
    return whole.unionByName(each)


def join_groups(groups: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """Links (a, b) between members of a group whose sets meet ``percent``:
    members of one group that reach each other by such links are joined by the
    result (and by equal ``label``).  ``groups``: g, node, label; ``sets``: node,
    n, set (sorted 64-bit elements).  A node may stand in several groups, once in
    each."""
    rows = freeze(groups.join(sets.select("node", "n"), "node"), f"{name}-members")
    size = F.greatest(F.sum("n") / F.lit(UNIT_ELEMENTS), F.count(F.lit(1)) / F.lit(UNIT_SETS))
    blocks = rows.groupBy("g").agg(F.ceil(size).cast("int").alias("nb"), F.count(F.lit(1)).alias("_m")).where("_m > 1").drop("_m")
    block = F.pmod(F.xxhash64("node", F.lit(5)), F.col("nb")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    units = rows.join(blocks, "g").withColumn("_b", block).withColumn("_o", other)
    units = units.select(
        "g", F.least("_b", "_o").alias("lo"), F.greatest("_b", "_o").alias("hi"), (F.col("_b") > F.col("_o")).cast("int").alias("side"), "node", "label"
    )
    key = ["g", "lo", "hi"]
    full = units.join(sets.select("node", "set"), "node").repartition(*key).sortWithinPartitions(*key, "side", "node")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole_groups(batches, key):
            out = []
            for _, u in b.groupby(key, sort=False):
                if len(u) > 1 and (u["lo"].iat[0] == u["hi"].iat[0] or u["side"].nunique() == 2):
                    node = u["node"].to_numpy()
                    found = links_of_unit([np.frombuffer(s, "<u8") for s in u["set"]], u["label"].to_numpy(), u["side"].to_numpy(), percent)
                    out += [(node[i], node[j]) for i, j in found]
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return full.select(*key, "side", "node", "label", "set").mapInPandas(lean(run), "a long, b long")
