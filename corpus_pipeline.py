"""Corpus pipeline: quality classifier, line dedup, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept;
all but the last return the columns of ``documents``.  :func:`run` writes each
stage to the shared folder and rereads it.

Near-dedup drops a text of a doc_id, not the id's other texts.  Null ids: the classifier judges them like others but cannot name them, so they
stay; near-dedup keeps them.  Documents that line dedup empties stay, empty.
Repeated rows of one doc_id and text are judged alike.  Empty tables pass.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, kneser_ney, line_runs, mixing, setsketch
from quarry.llm.common import BROADCAST_IDS, freeze, select_docs
from quarry.session import configure_session
from quarry.sources.tables import load


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity their language's bounds allow."""
    configure_session(spark)
    judged = kneser_ney.classify(docs, load(spark, sf_dir, "labels"))
    rejected = freeze(judged.where(~F.col("keep")).select("doc_id").distinct(), "rejected")
    return select_docs(docs, rejected, "left_anti").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies of repeated line runs; n_chars follows."""
    out = line_runs.remove_repeated_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    found = setsketch.near_duplicates(docs)
    dropped = found.where(~F.col("kept")).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")).distinct()
    dropped = freeze(dropped, "dropped")
    small = dropped.count() <= BROADCAST_IDS // 2  # 16 bytes a row
    same = (docs["doc_id"] == F.col("_d")) & (F.xxhash64(docs["text"]) == F.col("_t"))
    return docs.join(F.broadcast(dropped) if small else dropped, same, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mixture sends them: in its order, sources that end
    early repeated until the last one has sent all its blocks."""
    return mixing.in_mixture_order(docs, mixing.mix(docs)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids, and whether the ids decode to the text."""
    vocabulary, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe.round_trip(docs.select("doc_id", "source", "text"), vocabulary, pattern, keep_text=True)
    exact = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return both.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", exact.alias("round_trip"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("source mixing", mix_sources),
    ("tokens", tokens),
]

#: Perplexities, suffix ranks and byte merges have no SQL form; the tests hold
#: run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure_session(spark)
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = freeze(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
