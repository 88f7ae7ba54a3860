"""Token store and BPE against the tokenizer libraries themselves."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from docs_fixture import docs, none, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline as cp
from quarry.llm import bpe, queries, token_store
from quarry.session import scratch_path

SF = "/root/testdata/sf0.001"
VOCABULARY = P.path("byte_bpe_multi_50k.tiktoken")
BLANKS = st.text(st.sampled_from("ab1 \t\n\r\u00a0\u3000\x1c'sé,."), max_size=40)


@pytest.fixture(scope="module")
def reference():
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return t


def test_added_tokens_as_in_the_plain_call(plain):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z", "<| endoftext |> <|endoftext|"]
    coded = token_store.encoder(P.path("byte_bpe_50k.json")).encode(texts, 2)
    assert np.frombuffer(coded[0], "<u4").tolist() == [64, 220, 50256, 275, 2]
    assert [np.frombuffer(c, "<u4").tolist() for c in coded] == [[*plain.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_codes_give_random_access():
    rng = np.random.default_rng(3)
    for ids in (rng.integers(0, 50_000, 3000), rng.integers(0, 1 << 31, 700), np.array([0]), np.array([255, 256, 65535, 65536, 2**32 - 1])):
        packed = token_store.pack(ids.astype(np.uint32))
        assert (token_store.unpack(*packed[:2]) == ids).all()
        assert [token_store.access(*packed, i) for i in range(len(ids))] == ids.tolist()


@settings(max_examples=300, deadline=None)
@given(BLANKS)
def test_pieces_match_whole_texts(reference, plain, text):
    ids = np.frombuffer(bpe.codec(VOCABULARY, P.PATTERN).encode([text])[0], "<i4")
    assert ids.tolist() == reference.encode_ordinary(text)
    assert bpe.codec(VOCABULARY, P.PATTERN).decode(ids.astype(np.int64)) == text.encode()
    coded = np.frombuffer(token_store.encoder(P.path("byte_bpe_50k.json")).encode([text], 2)[0], "<u4")
    assert coded.tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2]


def test_store_matches_library(spark, plain):
    path = scratch_path(spark, "store")
    token_store.write_store(docs(spark), path, P.path("byte_bpe_50k.json"))
    got = sorted(map(tuple, token_store.read_store(spark, path).collect()), key=lambda r: r[1])
    want, start = [], 0
    for doc, text in sorted(((r[0], r[1]) for r in rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_store_of_nothing(spark):
    path = scratch_path(spark, "store")
    token_store.write_store(none(spark), path, P.path("byte_bpe_50k.json"))
    assert token_store.read_store(spark, path).count() == 0


def test_bpe_operator_keeps_rows_and_columns(spark, reference):
    coded = bpe.decode(bpe.encode(docs(spark), VOCABULARY, P.PATTERN, keep_text=True), VOCABULARY, P.PATTERN)
    got = coded.collect()
    assert len(got) == len(rows()) and "rank" in coded.columns
    for r in got:
        assert r["ids"] == reference.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.encode(none(spark), VOCABULARY, P.PATTERN).count() == 0


def test_queries(spark, reference, plain):
    table = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = {r["doc_id"]: r for r in queries.QUERIES["op4_sentencepiece_bpe"](spark, SF).collect()}
    store = {r["doc_id"]: r for r in queries.QUERIES["op3_token_store"](spark, SF).collect()}
    assert len(got) == len(store) == len(table)
    start = 0
    for d in table:
        ids = reference.encode_ordinary(d["text"] or "")
        r = got[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()
        ids = [*plain.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        assert tuple(store[d["doc_id"]])[1:] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_round_trip_in_one_worker(spark, capsys):
    """The two steps give what the two operators give, by one Python step a stage."""
    df = docs(spark)
    two = bpe.decode(bpe.encode(df, VOCABULARY, P.PATTERN, keep_text=True), VOCABULARY, P.PATTERN)
    one = bpe.round_trip(df, VOCABULARY, P.PATTERN, keep_text=True)
    assert one.schema == two.schema
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert bpe.round_trip(df, VOCABULARY, P.PATTERN).columns == bpe.decode(bpe.encode(df, VOCABULARY, P.PATTERN), VOCABULARY, P.PATTERN).columns
    for out in (cp.tokens(spark, df, SF), queries.QUERIES["op4_sentencepiece_bpe"](spark, SF)):
        capsys.readouterr()
        out.explain()
        assert capsys.readouterr().out.count("MapInArrow") == 1
