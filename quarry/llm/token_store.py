"""Token-ID store of directly addressable codes (DACs).

An id is cut into 8-bit chunks, lowest first.  Level 0 holds the first chunk
of every id, level 1 the second chunk of those that go on, and so forth; a
bitmap per level says which ids go on, and a rank directory (ones before every
512 bits) turns a position in one level into a position in the next.  Any id
is read from one byte and one rank per level, without decoding its block.

The files are a Parquet data set of records in ascending document order (file
name, then row): one record per block of documents, with the documents' ids
and starts and the block's levels, bitmaps and directories.

Rows with null or empty text hold the end id alone.  A null doc_id sorts
first, equal ids by text; repeated rows are stored as often as they occur.
Other columns are not read.  An empty table gives a store without records.
"""

from __future__ import annotations

import array
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import bucket_of, id_bounds
from quarry.llm.pretokens import PieceCache

SPAN = 512  # bits between two entries of a rank directory
_BLOCK = 1 << 18  # ids after which a block is closed at the next document
_BYTES = 4 << 20  # text that is encoded together

RECORD = (
    "shard int, block int, n_ids long, doc_ids array<bigint>, doc_starts array<bigint>, "
    "levels array<binary>, bitmaps array<binary>, ranks array<binary>"
)


def pack(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Levels, continuation bitmaps and rank directories of unsigned ids."""
    levels, bitmaps, ranks = [], [], []
    rest = ids.astype(np.uint32)
    while True:
        levels.append((rest & 0xFF).astype(np.uint8).tobytes())
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        bitmaps.append(bits.tobytes())
        before = np.concatenate([[0], np.cumsum(more, dtype=np.uint32)])[:-1] if len(more) else np.zeros(0)
        ranks.append(before[::SPAN].astype("<u4").tobytes())
        if not more.any():
            return levels, bitmaps, ranks
        rest = rest[more] >> 8


def unpack(levels: list[bytes], bitmaps: list[bytes]) -> np.ndarray:
    """All ids of a block."""
    below = None
    for chunk, bitmap in zip(reversed(levels), reversed(bitmaps), strict=True):
        value = np.frombuffer(chunk, np.uint8).astype(np.uint32)
        if below is not None:
            more = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=len(value), bitorder="little").view(bool)
            value[more] |= below << 8
        below = value
    return below


def access(levels: list[bytes], bitmaps: list[bytes], ranks: list[bytes], i: int) -> int:
    """Id number ``i`` of a block: one byte, one bit and one rank a level."""
    value = 0
    for k, (chunk, bitmap, directory) in enumerate(zip(levels, bitmaps, ranks, strict=True)):
        value |= chunk[i] << (8 * k)
        if not bitmap[i >> 3] >> (i & 7) & 1:
            return value
        start = i // SPAN * SPAN
        ones = int.from_bytes(bitmap[start // 8 : (i + 7) // 8], "little") & ((1 << (i - start)) - 1)
        i = int.from_bytes(directory[4 * (i // SPAN) : 4 * (i // SPAN) + 4], "little") + ones.bit_count()
    return value


def _byte_chars() -> dict[int, str]:
    """The characters that byte-level vocabularies write bytes with: printable
    Latin-1 bytes stand for themselves, the others follow from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(others)}


BYTE_CHARS = _byte_chars()


class Encoder:
    """Text -> ids with a ``tokenizers`` file, distinct pieces once."""

    def __init__(self, tokenizer: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer)
        self.tokenizer.encode_special_tokens = special_as_text
        self.model = self.tokenizer.model
        added = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache = PieceCache(self.encode_many, whole=tuple(added))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """A space and letters are one match of the split pattern, so the model
        takes such a word directly; other pieces go through the whole tokenizer."""
        plain = [t[:1] == " " and t[1:].isalpha() for t in texts]
        whole = iter(self.tokenizer.encode_batch_fast([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        tokenize, blank = self.model.tokenize, BYTE_CHARS[32]
        out = []
        for t, p in zip(texts, plain, strict=True):
            if p:
                # ASCII letters stand for themselves
                mapped = blank + t[1:] if t.isascii() else t.encode().decode("latin-1").translate(BYTE_CHARS)
                out.append(array.array("I", [x.id for x in tokenize(mapped)]).tobytes())
            else:
                out.append(array.array("I", next(whole).ids).tobytes())
        return out

    def encode(self, texts: list[str | None], end_id: int) -> list[bytes]:
        end = np.array([end_id], "<u4").tobytes()
        return [x + end for x in self.cache.encode([t or "" for t in texts])]


@lru_cache(maxsize=2)
def encoder(tokenizer: str) -> Encoder:
    """The worker's encoder; one thread, as Spark runs a task a core."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(tokenizer)


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Encodes ``docs`` (doc_id, text) and writes the store at ``path``.  The
    texts, smaller than their ids, are dealt by ranges of doc_id, whose bounds
    are read from the ids alone: the texts are scanned once."""
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = id_bounds(docs, "doc_id", shards)  # one row
    placed = docs.select("doc_id", "text").crossJoin(F.broadcast(bounds))
    placed = placed.withColumn("_shard", bucket_of(F.col("doc_id"), F.col("_bounds"), shards)).select("doc_id", "text", "_shard")
    ordered = placed.repartitionById(shards, F.col("_shard")).drop("_shard").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, shard, block = encoder(tokenizer), TaskContext.get().partitionId(), 0
        doc_ids: list = []
        parts: list[bytes] = []
        size = 0

        def record() -> pd.DataFrame:
            lengths = np.array([len(p) // 4 for p in parts], np.int64)
            levels, bitmaps, ranks = pack(np.frombuffer(b"".join(parts), "<u4"))
            row = (shard, block, int(lengths.sum()), list(doc_ids), (np.cumsum(lengths) - lengths).tolist(), levels, bitmaps, ranks)
            return pd.DataFrame([row], columns=["shard", "block", "n_ids", "doc_ids", "doc_starts", "levels", "bitmaps", "ranks"])

        for b in batches:
            ids = [None if pd.isna(x) else int(x) for x in b["doc_id"]]
            for at in range(0, len(b), 128):
                coded = enc.encode([t if isinstance(t, str) else "" for t in b["text"].iloc[at : at + 128]], end_id)
                for doc, p in zip(ids[at : at + 128], coded, strict=True):
                    doc_ids.append(doc)
                    parts.append(p)
                    size += len(p) // 4
                    if size >= _BLOCK:
                        yield record()
                        block, size = block + 1, 0
                        doc_ids.clear()
                        parts.clear()
        if parts:
            yield record()

    ordered.mapInPandas(run, RECORD).write.parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a store: doc_id, ``start`` (ids of all documents before
    it), n_tokens, ids_crc32.  Offsets of shards come from one row a shard."""
    records = spark.read.schema(RECORD).parquet(path)
    totals = records.groupBy("shard", "block").agg(F.sum("n_ids").alias("_n")).groupBy("shard").agg(F.sum("_n").alias("_n"))
    base = totals.select("shard", (F.sum("_n").over(Window.orderBy("shard")) - F.col("_n")).alias("_base"))
    blocks = records.select("shard", "block", "n_ids").withColumn(
        "_in_shard", F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_ids")
    )
    # one row a shard, and one a block of at least _BLOCK ids: both stay small beside the store
    offsets = blocks.join(base, "shard").select("shard", "block", (F.col("_base") + F.col("_in_shard")).alias("_offset"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                ids = unpack(list(r.levels), list(r.bitmaps)).astype("<u4")
                starts = np.asarray(r.doc_starts, np.int64)
                ends = np.append(starts[1:], r.n_ids)
                yield pd.DataFrame(
                    {
                        "shard": r.shard,
                        "block": r.block,
                        "doc_id": pd.array([None if pd.isna(x) else int(x) for x in r.doc_ids], "Int64"),
                        "local": starts,
                        "n_tokens": ends - starts,
                        "ids_crc32": [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(starts, ends, strict=True)],
                    }
                )

    docs = records.mapInPandas(run, "shard int, block int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return docs.join(offsets, ["shard", "block"]).select(
        "doc_id", (F.col("_offset") + F.col("local")).alias("start"), "n_tokens", "ids_crc32"
    )
