"""Alignment of two tokenizers against a plain walk over byte ranges."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from docs_fixture import docs, none, rows
from tokenizers import Tokenizer

from quarry.llm import queries, token_alignment

SF = "/root/testdata/sf0.001"
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def plain(table):
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    chars = own + [b for b in range(256) if b not in own]
    back = {chr(b) if i < len(own) else chr(0x100 + i - len(own)): b for i, b in enumerate(chars)}

    def piece(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()

    out, held = [], Counter()
    for doc, text in table:
        a = b = []
        if text:
            a, b = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            raw = [bytes(back[c] for c in tok.id_to_token(i)) for i in a], [piece(i) for i in b]
            if not b"".join(raw[0]) == b"".join(raw[1]) == (" " + text).encode():
                a = b = []
        groups, links = [], []
        i = j = x = y = 0
        ga, gb = [], []
        while i < len(a) and j < len(b):
            links.append((a[i], b[j]))
            ea, eb = x + len(raw[0][i]), y + len(raw[1][j])
            if ea <= eb:
                ga.append(a[i])
                i, x = i + 1, ea
            if eb <= ea:
                gb.append(b[j])
                j, y = j + 1, eb
            if ea == eb:
                groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
                ga, gb = [], []
        held.update(set(links))
        out.append((doc, a, b, groups, links))
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    return sorted(
        (
            (
                doc, len(a), len(b), len(groups), len(links), sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links),
                ";".join(groups),
            )
            for doc, a, b, groups, links in out
        ),
        key=str,
    )


def odd_texts():
    texts = ["<|endoftext|> <s> </s> <unk> <0x41>", "a<|endoftext|>b", "▁x y", "\x00 z", "tabs\there\n\nand  two", " lead", "あ \U0001f600 é́ ﬁ",
             "x" * 5000, "word " * 3000 + "end", "12345 67,890.12 don't"]
    return [(1000 + i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("shard", [token_alignment.SHARD_CHARS, 300])
def test_fixture(spark, monkeypatch, shard):
    monkeypatch.setattr(token_alignment, "SHARD_CHARS", shard)
    monkeypatch.setattr(token_alignment, "_CHARS", 2000)
    table = [(r[0], r[1]) for r in rows()] + odd_texts()
    df = docs(spark).select("doc_id", "text", "n").unionByName(spark.createDataFrame([(*r, 1) for r in odd_texts()], "doc_id long, text string, n int"))
    got = token_alignment.align(df, A, B)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(table)
    assert token_alignment.align(none(spark), A, B).count() == 0


@pytest.mark.parametrize("work", [1, 2, 7, 64, 1 << 16])
def test_pieces_of_any_size_agree(work):
    rng = np.random.default_rng(work)
    for _ in range(60):
        total = int(rng.integers(1, 400))
        ends = [np.unique(np.append(rng.integers(1, total + 1, rng.integers(0, 200)), total)) for _ in range(2)]
        every = np.union1d(*ends)
        i, j, cut = token_alignment.overlaps(*ends, work)
        assert (i == np.searchsorted(ends[0], every)).all() and (j == np.searchsorted(ends[1], every)).all()
        assert (cut == np.isin(every, np.intersect1d(*ends))).all()
        cuts = token_alignment.diagonal_cuts(*ends, work)
        steps = np.diff(np.append(np.arange(0, len(ends[0]) + len(ends[1]), work), len(ends[0]) + len(ends[1])))
        assert steps.max() <= work and cuts[0] == 0 and cuts[-1] == len(ends[0])


def test_forgetting_words(monkeypatch):
    monkeypatch.setattr(token_alignment, "_WORDS", 3)
    x, y = token_alignment.Aligner(A, B), token_alignment.Aligner(A, B)
    texts = ["one two three four", "two five  six", "one seven two", "eight one"]
    few = [r for t in texts for r in x.align([t])]
    assert [(r[0].tolist(), r[1], r[2].tolist(), r[3].tolist()) for r in few] == [
        (r[0].tolist(), r[1], r[2].tolist(), r[3].tolist()) for r in y.align(texts)
    ]


def test_query(spark):
    table = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = queries.QUERIES["op11_merge_path_alignment"](spark, SF)
    want = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in plain(table)]
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in df.collect()), key=str) == sorted(want, key=str)
