"""Byte-level BPE encoding and decoding through a sentencepiece model.

The model is serialised directly from a rank file: byte ``b`` of a token is
the character ``chr(0x100 + b)``, a token's score is its negative rank (so the
lowest rank merges first), normalisation is the identity.  Texts are split by
the vocabulary's pattern and each pre-token is encoded on its own; a pre-token
that is itself a token is that token, whether or not merges reach it.

Null and empty texts have no ids.  Every input row gives one output row;
repeated rows stay; columns other than the named ones are passed through, and
a column that already has the name of an output is replaced.
"""

from __future__ import annotations

import array
import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarry.llm.common import lean
from quarry.llm.pretokens import PieceCache

_TEXTS = 256  # texts of an Arrow batch that are encoded together, at most
_CHARS = 2 << 20  # characters of them, about
_PIECES = 150_000  # pieces that a task remembers, in each of two generations


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a rank file (one ``base64 rank`` line a token)."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks; the unknown
    piece, which byte coverage leaves unused, follows the last rank."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    by_rank = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    model = pb.ModelProto()
    for rank, token in enumerate(by_rank):
        model.pieces.add(piece="".join(chr(0x100 + b) for b in token), score=-float(rank))
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    spec, norm = model.trainer_spec, model.normalizer_spec
    spec.model_type, spec.vocab_size = pb.TrainerSpec.BPE, len(by_rank) + 1
    spec.unk_id, spec.bos_id, spec.eos_id, spec.pad_id = len(by_rank), -1, -1, -1
    norm.name, norm.precompiled_charsmap = "identity", b""
    norm.add_dummy_prefix = norm.remove_extra_whitespaces = norm.escape_whitespaces = False
    return model.SerializeToString()


class Codec:
    """Encoder and decoder of one rank file and split pattern."""

    def __init__(self, vocabulary: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(vocabulary)
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.ranks))
        self.pattern = regex.compile(pattern)
        self.to_chars = {b: 0x100 + b for b in range(256)}
        self.cache = PieceCache(self._encode_many, _PIECES)
        tokens = sorted(self.ranks, key=self.ranks.__getitem__)
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_len = np.array([len(t) for t in tokens], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len

    def _encode_many(self, texts: list[str]) -> Iterator[bytes]:
        found = [self.pattern.findall(t) for t in texts]
        words, hard = {}, []
        for w in set().union(*found):
            raw = w.encode()
            rank = self.ranks.get(raw)
            if rank is None:
                hard.append((w, raw.decode("latin-1").translate(self.to_chars)))
            else:
                words[w] = rank.to_bytes(4, "little")
        if hard:
            for (w, _), ids in zip(hard, self.processor.encode([c for _, c in hard], num_threads=1), strict=True):
                words[w] = array.array("i", ids).tobytes()
        return (b"".join([words[w] for w in ws]) for ws in found)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        return self.cache.encode([t or "" for t in texts])

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of an id sequence (the inverse byte mapping, whole)."""
        n = self.token_len[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        index = np.repeat(self.token_at[ids] - (ends - n), n) + np.arange(total)
        return self.token_bytes[index].tobytes()


@lru_cache(maxsize=2)
def codec(vocabulary: str, pattern: str) -> Codec:
    """The worker's codec of a vocabulary."""
    return Codec(vocabulary, pattern)


def _steps(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``_TEXTS`` rows and about ``_CHARS`` characters."""
    size = pa.compute.utf8_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
    before = np.cumsum(size) - size
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, min(at + _TEXTS, int(np.searchsorted(before, before[at] + _CHARS))))
        yield batch.slice(at, end - at)
        at = end


def _with(schema: T.StructType, name: str, kind: T.DataType) -> tuple[T.StructType, list[str]]:
    kept = [f for f in schema.fields if f.name != name]
    return T.StructType([*kept, T.StructField(name, kind)]), [f.name for f in kept]


def _encoded(vocabulary: str, pattern: str, text: str, kept: list[str], out: str) -> Callable[[Iterator], Iterator]:
    """Batches -> their columns ``kept`` and ``out``, the ids of ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, pattern)
        for whole in batches:
            for b in _steps(whole, text):
                parts = c.encode(b.column(text).to_pylist())
                ends = np.cumsum([0] + [len(p) // 4 for p in parts], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), "<i4")))
                yield pa.RecordBatch.from_arrays([b.column(k) for k in kept] + [ids], names=[*kept, out])
        c.cache.forget()  # a worker outlives its task

    return run


def _decoded(vocabulary: str, pattern: str, ids: str, kept: list[str], out: str) -> Callable[[Iterator], Iterator]:
    """Batches -> their columns ``kept`` and ``out``, the bytes of ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, _TEXTS):
                b = whole.slice(at, _TEXTS)
                col = b.column(ids)
                flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.cumsum(pa.compute.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
                done = pa.array([c.decode(flat[s:e]) for s, e in zip(starts, ends, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(k) for k in kept] + [done], names=[*kept, out])

    return run


def _encoding(df: DataFrame, text: str, out: str, keep_text: bool) -> tuple[T.StructType, list[str]]:
    schema, kept = _with(df.schema, out, T.ArrayType(T.IntegerType(), False))
    if not keep_text:
        kept = [c for c in kept if c != text]
        schema = T.StructType([f for f in schema.fields if f.name != text])
    return schema, kept


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", out: str = "ids", keep_text: bool = False) -> DataFrame:
    """Adds ``out`` array<int>, the ids of ``text``; drops ``text`` unless kept."""
    schema, kept = _encoding(df, text, out, keep_text)
    return df.mapInArrow(lean(_encoded(vocabulary, pattern, text, kept, out)), schema)


def decode(df: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out`` binary, the bytes of the id array ``ids`` (null: empty)."""
    schema, kept = _with(df.schema, out, T.BinaryType())
    return df.mapInArrow(lean(_decoded(vocabulary, pattern, ids, kept, out)), schema)


def round_trip(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids", out: str = "decoded", keep_text: bool = False) -> DataFrame:
    """:func:`encode`, then :func:`decode` of its ids, by one worker a task: two
    operators in one stage keep two, and both stay for the stages after it."""
    schema, kept = _encoding(df, text, ids, keep_text)
    to_ids = _encoded(vocabulary, pattern, text, kept, ids)
    schema, kept = _with(schema, out, T.BinaryType())
    back = _decoded(vocabulary, pattern, ids, kept, out)
    return df.mapInArrow(lean(lambda batches: back(to_ids(batches))), schema)
