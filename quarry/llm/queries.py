"""Registered queries of the training-data operators: each runs its operator,
with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, chat, hard_negatives, kneser_ney, line_runs, mixing, ngram_join, order_minhash, pii, pivot_index, setsketch, token_alignment, token_store
from quarry.llm.common import freeze
from quarry.session import configure_session, scratch_path
from quarry.sources.tables import load


def op1_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op2_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(load(spark, sf_dir, "documents"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-store")
    token_store.write_store(load(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.read_store(spark, path)


def op4_sentencepiece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe.round_trip(load(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, pattern)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_pfair_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents"))


def op6_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit(said).alias("text"),
    )
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    made = freeze(chat.format_conversations(turns), "chat")
    examples = freeze(chat.examples(made), "chat-examples")  # one row an assistant turn
    read = chat.parse(chat.with_examples(made, examples))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op7_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = pivot_index.integer_vectors(load(spark, sf_dir, "embeddings"))
    return pivot_index.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


def op8_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(load(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[pii.count_kind("base", k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.joined("base"), 256).alias("base_sha256"),
        pii.joined("spans").alias("spans"),
    )


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.compare_edited(load(spark, sf_dir, "documents")).select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


def op10_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.remove_repeated_lines(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_merge_path_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    out = token_alignment.align(load(spark, sf_dir, "documents"), a, b, digest=True)
    return out.withColumnRenamed("groups", "groups_sha256")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.labelled_vectors(load(spark, sf_dir, "embeddings"), moved)
    return hard_negatives.mine(rows, rows.where(F.col("vec_id") % 100 == 0))


def op13_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_sets(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: (lambda spark, sf_dir, f=f: f(configure_session(spark), sf_dir))
    for f in (
        op1_kneser_ney_quality,
        op2_setsketch_near_dedup,
        op3_token_store,
        op4_sentencepiece_bpe,
        op5_pfair_mixture,
        op6_chat_prefix_targets,
        op7_pivot_top_k,
        op8_bootstrapped_pii,
        op9_order_minhash,
        op10_line_runs,
        op11_merge_path_alignment,
        op12_hard_negatives,
        op13_ngram_jaccard,
    )
}

ORACLES: dict[str, str] = {}
