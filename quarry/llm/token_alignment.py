"""Cross-tokenizer alignment by merge-path partitioning.

Both token sequences of a text are read as ascending byte ends.  Merging them
walks a path through the grid of (A token, B token); diagonals of the grid cut
the path into pieces of equal work, whatever the texts' lengths, and a binary
search on each diagonal finds the cut.  Every piece is merged on its own and
emits its overlaps: each end closes one pair of overlapping tokens.  An end of
both sequences closes a group; one whose halves lie in two pieces is seen by a
look across the border, which stitches the groups together.

A text is aligned by segments: between words parted by single spaces both
tokenizers surely end, so a task aligns each distinct word once (its memory of
words is bounded and ends with it), and a text is the sequence of its words'
groups.  Texts with other blanks are one segment.

A link's count is the number of texts that hold its pair of ids.  Texts are
collected in shards of bounded size; a shard's distinct pairs are counted
before they are shuffled, and come back with their corpus-wide counts, once for
all texts of the shard.

Null and empty texts, and texts that either tokenizer does not give back byte
by byte, have no tokens: zeros, and empty groups.  Every row gives one row;
repeated rows count as often as they occur.  Null ids stay null.  Other columns
are not read.  A very long text is held whole by one task, with about 100 bytes
a token.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import freeze, whole_groups
from quarry.llm.pretokens import is_plain
from quarry.llm.token_store import BYTE_CHARS, Encoder

WORK = 1 << 16  # merge steps of a piece
SHARD_CHARS = 8 << 20  # of texts, after which a shard is closed
_CHARS = 2 << 20  # of texts that are aligned together
_WORDS, _LINKS = 150_000, 2_000_000  # of segments that a task remembers
_LEAD = "▁"


def diagonal_cuts(a: np.ndarray, b: np.ndarray, work: int = WORK) -> np.ndarray:
    """Elements of ``a`` before each diagonal 0, work, 2 * work, ..., len(a) +
    len(b) in the merge of two ascending sequences (at ties ``a`` first)."""
    total = len(a) + len(b)
    d = np.append(np.arange(0, total, work), total)
    lo, hi = np.maximum(d - len(b), 0), np.minimum(d, len(a))
    while (lo < hi).any():
        mid = (lo + hi) // 2
        go = lo < hi
        # the path takes a[mid] before b[d - mid - 1]: the cut lies beyond
        ahead = go & (a[np.minimum(mid, len(a) - 1)] <= b[np.clip(d - mid - 1, 0, len(b) - 1)])
        lo = np.where(ahead, mid + 1, lo)
        hi = np.where(go & ~ahead, mid, hi)
    return lo


def merge_piece(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A numbers, B numbers and ``cut`` (does a group end here) of the overlaps
    that end in one piece, in order."""
    x, y = a[i0:i1], b[j0:j1]
    jx = j0 + np.searchsorted(y, x, side="left")
    iy = i0 + np.searchsorted(x, y, side="right")
    # an end of both is emitted by a; the other half may lie across the border
    cut = np.zeros(len(x), bool)
    inside = jx < len(b)
    cut[inside] = b[jx[inside]] == x[inside]
    before = iy - 1
    again = np.zeros(len(y), bool)
    again[before >= 0] = a[before[before >= 0]] == y[before >= 0]
    place = np.concatenate([np.arange(i0, i1) + jx, np.arange(j0, j1) + iy])
    keep = np.concatenate([np.ones(len(x), bool), ~again])
    order = np.argsort(place[keep])
    out = [np.concatenate(p)[keep][order] for p in ((np.arange(i0, i1), iy), (jx, np.arange(j0, j1)), (cut, np.zeros(len(y), bool)))]
    return out[0], out[1], out[2]


def overlaps(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All overlaps of two token sequences with these byte ends (ascending, with
    the same last end): token numbers, and where groups end."""
    if not len(a):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, bool)
    d = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    i = diagonal_cuts(a, b, work)
    j = d - i
    pieces = [merge_piece(a, b, *cut) for cut in zip(i, i[1:], j, j[1:])]
    return tuple(np.concatenate(p) for p in zip(*pieces))


class Aligner:
    """Both tokenizers, and the segments aligned so far (numbers from 0)."""

    def __init__(self, tokenizer: str, pieces: str):
        import sentencepiece

        self.a = Encoder(tokenizer, special_as_text=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        back = {c: bytes([k]) for k, c in BYTE_CHARS.items()}
        vocab = sorted((i, t) for t, i in self.a.tokenizer.get_vocab().items())
        a_bytes = [b""] * (vocab[-1][0] + 1)
        for i, t in vocab:
            a_bytes[i] = b"".join(back.get(c, c.encode()) for c in t)
        self.n_b = self.b.get_piece_size()
        b_bytes = []
        for i in range(self.n_b):
            piece = self.b.id_to_piece(i)
            b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(_LEAD, " ").encode())
        self.bytes_a, self.bytes_b = np.array(a_bytes, object), np.array(b_bytes, object)
        self.len_a, self.len_b = (np.array([len(t) for t in x], np.int64) for x in (a_bytes, b_bytes))
        self.key = "<u4" if len(a_bytes) * self.n_b < 1 << 32 else "<u8"
        # written ids, with what follows them inside and at the end of a group
        self.write_a = np.array([f"{i}," for i in range(len(a_bytes))] + [f"{i}|" for i in range(len(a_bytes))], object)
        self.write_b = np.array([f"{i}," for i in range(self.n_b)] + [f"{i};" for i in range(self.n_b)], object)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts = np.zeros((0, 5), np.int64)  # n_a, n_b, n_groups, n_links, sound
        self.link_at = np.zeros(0, np.int64)
        self.links = np.zeros(0, self.key)

    def _sound(self, ids: np.ndarray, table: np.ndarray, lens: np.ndarray, first: np.ndarray, raw: list[bytes]) -> np.ndarray:
        """Whether each segment's tokens, joined, are its bytes."""
        if b"".join(table[ids]) == b"".join(raw) and (np.add.reduceat(np.append(lens[ids], 0), first[:-1]) == [len(r) for r in raw]).all():
            return np.ones(len(raw), bool)
        return np.array([b"".join(table[ids[s:e]]) == r for s, e, r in zip(first, first[1:], raw)], bool)

    def learn(self, segments: list[str]) -> None:
        """Aligns new segments, together, and numbers them on."""
        raw = [b" " + s.encode() for s in segments]
        coded = self.a.encode_many([" " + s for s in segments])
        a = np.frombuffer(b"".join(coded), "<u4").astype(np.int64)
        at_a = np.cumsum([0] + [len(c) // 4 for c in coded])
        lists = self.b.encode(segments, num_threads=1)
        b = np.array([i for x in lists for i in x], np.int64)
        at_b = np.cumsum([0] + [len(x) for x in lists])
        sound = (np.diff(at_a) > 0) & (np.diff(at_b) > 0)
        if sound.all():
            sound &= self._sound(a, self.bytes_a, self.len_a, at_a, raw) & self._sound(b, self.bytes_b, self.len_b, at_b, raw)
        else:
            sound &= [b"".join(self.bytes_a[a[s:e]]) == r == b"".join(self.bytes_b[b[t:f]]) for s, e, t, f, r in zip(at_a, at_a[1:], at_b, at_b[1:], raw)]
        for x, at in ((0, at_a), (1, at_b)):  # unsound segments have no tokens
            n = np.where(sound, np.diff(at), 0)
            keep = np.repeat(sound, np.diff(at))
            if x == 0:
                a, n_a = a[keep], n
            else:
                b, n_b = b[keep], n
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        i, j, cut = overlaps(end_a, end_b)
        links = (a[i] * self.n_b + b[j]).astype(self.key)
        last_a = np.cumsum(n_a)
        link_end = np.searchsorted(i, last_a, side="left")  # a segment's links end where its A tokens do
        n_links = np.diff(np.concatenate([[0], link_end]))
        cuts = np.concatenate([[0], np.cumsum(cut)])
        n_groups = np.diff(cuts[np.concatenate([[0], link_end])])
        # ids are written group by group: A ids, then B ids
        end_of = np.flatnonzero(cut)
        closes_a, closes_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        closes_a[i[end_of]], closes_b[j[end_of]] = True, True
        last_in_a, last_in_b = np.flatnonzero(closes_a), np.flatnonzero(closes_b)
        group_a, group_b = (np.cumsum(c) - c for c in (closes_a, closes_b))
        written = np.empty(len(a) + len(b), object)
        before_b = np.concatenate([[0], last_in_b + 1])
        written[np.arange(len(a)) + before_b[group_a]] = self.write_a[a + closes_a * len(self.len_a)]
        if len(b):
            written[np.arange(len(b)) + (last_in_a + 1)[group_b]] = self.write_b[b + closes_b * self.n_b]
        written = written.tolist()
        stop = np.cumsum(n_a + n_b)
        self.groups += ["".join(written[s:e]) for s, e in zip((stop - n_a - n_b).tolist(), stop.tolist())]
        self.counts = np.concatenate([self.counts, np.stack([n_a, n_b, n_groups, n_links, sound], axis=1)])
        self.link_at = np.concatenate([self.link_at, len(self.links) + link_end - n_links])
        self.links = np.concatenate([self.links, links])

    def align(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, str, np.ndarray, np.ndarray]]:
        """Of each text: (n_a, n_b, n_groups, n_links), groups, its different
        pairs, ascending, and how often each is linked."""
        if len(self.groups) > _WORDS or len(self.links) > _LINKS:
            self.forget()
        parts: list[list[str] | int | None] = []
        new: list[str] = []
        base = len(self.groups)
        get = self.number.get
        for t in texts:
            if not t:
                parts.append(None)
            elif is_plain(t):
                words = t.split(" ")
                for w in words:
                    if get(w) is None:
                        self.number[w] = base + len(new)
                        new.append(w)
                parts.append(words)
            else:
                parts.append(base + len(new))
                new.append(t)
        if new:
            self.learn(new)
        number = self.number.__getitem__
        for p in parts:
            if p is None:
                yield np.zeros(4, np.int64), "", np.zeros(0, self.key), np.zeros(0, "<u4")
                continue
            at = np.array([p]) if isinstance(p, int) else np.fromiter(map(number, p), np.int64, len(p))
            counts = self.counts[at]
            if not counts[:, 4].all():
                yield np.zeros(4, np.int64), "", np.zeros(0, self.key), np.zeros(0, "<u4")
                continue
            n = counts[:, 3]
            end = np.cumsum(n)
            links = self.links[np.repeat(self.link_at[at] - (end - n), n) + np.arange(end[-1])]
            pairs, times = np.unique(links, return_counts=True)
            yield counts[:, :4].sum(axis=0), "".join([self.groups[x] for x in at.tolist()])[:-1], pairs, times.astype("<u4")


_ROWS = "shard long, kind int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary"


def _aligned(docs: DataFrame, tokenizer: str, pieces: str, digest: bool) -> DataFrame:
    """One row a text (kind 1), and one a shard (kind 0): its different pairs and
    the number of its texts that hold each."""
    names = [c.split()[0] for c in _ROWS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        aligner, task, k = Aligner(tokenizer, pieces), TaskContext.get().partitionId(), 0
        held, chars = [], 0

        def close() -> pd.DataFrame:
            nonlocal k, held, chars
            pairs, times = np.unique(np.concatenate(held), return_counts=True)
            row = ((task << 32) + k, 0, None, 0, 0, 0, 0, None, pairs.astype("<i8").tobytes(), times.astype("<u4").tobytes())
            k, held, chars = k + 1, [], 0
            return pd.DataFrame([row], columns=names).astype({"doc_id": "Int64"})

        for whole in batches:
            size = whole["text"].str.len().fillna(0).to_numpy(np.int64)
            step = (np.cumsum(size) - size) // _CHARS
            for at in np.split(np.arange(len(whole)), np.flatnonzero(np.diff(step)) + 1):
                b = whole.iloc[at]
                out = []
                texts = [t if isinstance(t, str) else None for t in b["text"]]
                for doc, (n, groups, pairs, times) in zip(b["doc_id"], aligner.align(texts), strict=True):
                    held.append(pairs)
                    if digest:
                        groups = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
                    out.append(((task << 32) + k, 1, None if pd.isna(doc) else int(doc), *n.tolist(), groups, pairs.tobytes(), times.tobytes()))
                yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})
                chars += int(size[at].sum())
                if chars >= SHARD_CHARS:
                    yield close()
        if held:
            yield close()

    return docs.select("doc_id", "text").mapInPandas(run, _ROWS)


def _pairs(shards: DataFrame) -> DataFrame:
    """shard, pair, n of the shards' rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                yield pd.DataFrame({"shard": r.shard, "pair": np.frombuffer(r.pairs, "<i8"), "n": np.frombuffer(r.times, "<u4").astype(np.int64)})

    return shards.select("shard", "pairs", "times").mapInPandas(run, "shard long, pair long, n long")


def align(docs: DataFrame, tokenizer: str, pieces: str, digest: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups: A is the
    ``tokenizers`` file on a space and the text, B the sentencepiece model on the
    text.  ``groups`` is ``a1,a2|b1;a3|b2,b3``, or its SHA-256 with ``digest``
    (then the texts of groups, larger than the table, never leave their task)."""
    import sentencepiece

    n_b = sentencepiece.SentencePieceProcessor(model_file=pieces).get_piece_size()
    rows = freeze(_aligned(docs, tokenizer, pieces, digest), "align-rows")
    each = _pairs(rows.where("kind = 0"))
    counts = freeze(each.groupBy("pair").agg(F.sum("n").alias("count")), "align-counts")
    a = F.call_function("div", F.col("pair"), F.lit(n_b)).alias("a")
    top = counts.groupBy(a).agg(F.max("count").alias("most"))
    known = counts.withColumn("a", a).join(top, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    mine = each.select("shard", "pair").join(known, "pair").repartition("shard").sortWithinPartitions("shard", "pair")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole_groups(batches, ["shard"]):
            for shard, g in b.groupby("shard", sort=False):
                cols = (g["pair"].astype("<i8"), g["count"].astype("<i8"), g["best"].astype(bool))
                yield pd.DataFrame([(shard, 0, *(c.to_numpy().tobytes() for c in cols))], columns=["shard", "kind", "pairs", "times", "best"])

    lookup = mine.mapInPandas(pack, "shard long, kind int, pairs binary, times binary, best binary")
    both = rows.where("kind = 1").unionByName(lookup, allowMissingColumns=True)
    dealt = both.repartition("shard").sortWithinPartitions("shard", "kind")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, pairs, counts, best = None, None, None, None
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if r.kind == 0:
                    shard, pairs, counts = r.shard, np.frombuffer(r.pairs, "<i8"), np.frombuffer(r.times, "<i8")
                    best = np.frombuffer(r.best, bool)
                    continue
                n_best = total = 0
                if len(r.pairs):
                    assert r.shard == shard
                    times = np.frombuffer(r.times, "<u4").astype(np.int64)
                    at = np.searchsorted(pairs, np.frombuffer(r.pairs, f"<u{4 * len(r.pairs) // len(r.times)}").astype(np.int64))
                    n_best, total = int(times[best[at]].sum()), int((times * counts[at]).sum())
                out.append((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, n_best, total, r.groups))
            made = pd.DataFrame(out, columns=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])
            made["doc_id"] = pd.array([None if pd.isna(x) else int(x) for x in made["doc_id"]], "Int64")
            yield made

    return dealt.mapInPandas(
        read, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    )
