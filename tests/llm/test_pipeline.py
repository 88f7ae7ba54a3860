"""The pipeline's stages against what each must do with its own input."""

import sys
from collections import Counter

import base64
import os

import public_tokenizers as P
import tiktoken
from docs_fixture import docs, none
from test_line_runs import plain as plain_lines
from test_line_runs import rewritten
from test_near_dedup import plain as plain_near

import corpus_pipeline as cp
from quarry.llm import kneser_ney, line_runs
from quarry.llm.common import freeze

SF = "/root/testdata/sf0.001"


def ids_by_tiktoken():
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_stages_and_run(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "line dedup", "near dedup", "source mixing", "tokens"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r["doc_id"] for r in kneser_ney.classify(table, labels).collect() if r["keep"]}
    before = sorted((r["doc_id"], r["text"]) for r in table.collect() if r["doc_id"] in kept)
    cut = plain_lines(before, line_runs.MIN_WORDS)
    lined = [(d, rewritten(t, cut[(d, t)])) for d, t in before]
    near = plain_near(lined)
    left = {d: t for d, t in lined if near[d][2]}
    encode = ids_by_tiktoken()
    got = cp.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == set(left)
    for r in got:
        assert r["ids"] == encode(left[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) and r["round_trip"]
    source = {r["doc_id"]: r["source"] for r in table.collect()}
    assert all(r["source"] == source[r["doc_id"]] for r in got)
    assert min(Counter(r["doc_id"] for r in got).values()) == 1


def test_stages_keep_columns(spark):
    for make in (docs, none):
        df = make(spark)
        for _, stage in cp.STAGES[:-1]:
            df = freeze(stage(spark, df, SF), "test-stage")
            assert df.columns == make(spark).columns
        assert cp.tokens(spark, df, SF).columns == ["doc_id", "source", "n_tokens", "ids", "round_trip"]


def test_entry_without_the_operators():
    """The other queries do not need this subpackage."""
    import subprocess

    code = (
        "import sys\n"
        "class No:\n"
        "    def find_spec(self, name, *a):\n"
        "        if name in ('corpus_pipeline', 'quarry.llm'): raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "assert not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']; assert len(e.queries()) > 100\n"
    )
    root = os.path.dirname(os.path.abspath(cp.__file__))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
