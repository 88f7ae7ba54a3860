"""Order MinHash fingerprints, with DataFrame functions only.

k-mers are runs of ``K`` blank-separated words (a text of fewer words is one
k-mer).  Each occurrence of a k-mer is numbered in text order; the hash of
(k-mer, number) falls in one of ``SKETCHES`` ranges; in each range the
``MINIMA`` smallest are selected, put back in text order and hashed as a
tuple.  Equal tuples need the same k-mers in the same order, so the share of
equal tuples falls with edit distance, where a plain MinHash ignores moves.

A text without words has the empty fingerprint; two empty ones are alike (1).
Every row gives one row.  Null texts are empty.  The next document is that of
the next smaller doc_id (nulls last, equal ids by descending text); after the
last comes the first, so a lone row follows itself.  Other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import bucket_of, buckets_for, id_bounds

K = 3
SKETCHES = 64  # a power of two
MINIMA = 2
_SHIFT = 64 - (SKETCHES.bit_length() - 1)
_STEPS = [1 << i for i in reversed(range(31))]  # number of an occurrence, by binary search


def _range(h: Column) -> Column:
    return F.shiftrightunsigned(h, _SHIFT)


def fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: array<struct<b:bigint,s:bigint>>, one tuple hash for each
    non-empty range in ascending (signed) order."""
    w, a, n, k = (f"_{x}_{out}" for x in "wank")
    blank = F.lit(" \t\n\x0b\x0c\r")
    df = df.withColumn(w, F.split(F.btrim(F.coalesce(F.col(text), F.lit("")), blank), r"[\x20\x09-\x0D]+"))
    words = F.col(w)
    # all k-mers with their places, equal ones together in text order
    kmers = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(words) - K, F.lit(0))),
        lambda i: F.struct(F.xxhash64(*[F.coalesce(F.get(words, i + j), F.lit("")) for j in range(K)], F.size(words) >= K).alias("h"), i.alias("p")),
    )
    none = F.array().cast("array<struct<h:bigint,p:int>>")
    df = df.withColumn(a, F.when((F.size(words) > 1) | (words[0] != ""), F.sort_array(kmers)).otherwise(none)).drop(w)
    srt = F.col(a)

    def numbered(x: Column, j: Column) -> Column:
        number = F.aggregate(
            F.array(*[F.lit(s) for s in _STEPS]),
            F.lit(0),
            lambda o, s: F.when((j - o - s >= 0) & (F.get(srt, j - o - s)["h"] == x["h"]), o + s).otherwise(o),
        )
        again = (j > 0) & (F.get(srt, j - 1)["h"] == x["h"])
        return F.struct(F.xxhash64(x["h"], F.when(again, number).otherwise(F.lit(0))).alias("h"), x["p"].alias("p"))

    df = df.withColumn(n, F.sort_array(F.transform(srt, numbered))).drop(a)
    by_hash = F.col(n)
    df = df.withColumn(
        k, F.filter(by_hash, lambda x, j: (j < MINIMA) | (_range(F.get(by_hash, j - MINIMA)["h"]) != _range(x["h"])))
    ).drop(n)
    kept = F.col(k)

    def tuple_hash(x: Column, j: Column) -> Column:
        y = F.get(kept, j + 1)
        pair = y.isNotNull() & (_range(y["h"]) == _range(x["h"]))
        first = (j == 0) | (_range(F.get(kept, F.greatest(j - 1, F.lit(0)))["h"]) != _range(x["h"]))
        in_order = F.when(x["p"] < y["p"], F.xxhash64(x["h"], y["h"])).otherwise(F.xxhash64(y["h"], x["h"]))
        return F.when(first, F.struct(_range(x["h"]).alias("b"), F.when(pair, in_order).otherwise(F.xxhash64(x["h"])).alias("s")))

    return df.withColumn(out, F.filter(F.transform(kept, tuple_hash), lambda x: x.isNotNull())).drop(k)


def likeness(a: str, b: str) -> Column:
    """Equal tuples over ranges that either text fills."""
    same = F.size(F.array_intersect(F.col(a), F.col(b)))
    both = F.size(F.array_intersect(F.col(f"{a}.b"), F.col(f"{b}.b")))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(same / F.greatest(either, F.lit(1))).cast("double")


def as_text(fp: str) -> Column:
    return F.array_join(F.transform(F.col(fp), lambda x: F.concat(F.lower(F.hex(x["b"])), F.lit("."), F.lower(F.hex(x["s"])))), "-")


def with_next(docs: DataFrame) -> DataFrame:
    """Every row with its order block; the first row of the following block
    is sent along, so ``lead`` inside a block sees every next document and the
    texts are shuffled once."""
    count = buckets_for(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bounds = F.broadcast(id_bounds(rows.select("doc_id"), "doc_id", count))  # one row of at most `count` numbers
    block = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(bucket_of(F.col("doc_id"), F.col("_bounds"), count))
    placed = rows.crossJoin(bounds).select("doc_id", "text", block.alias("_block"))
    ids = rows.select("doc_id").crossJoin(bounds).select("doc_id", block.alias("_block"))
    tops = ids.groupBy("_block").agg(F.max("doc_id").alias("_top"))
    order = Window.orderBy("_block")  # at most `count` + 1 rows
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = tops.select("_block", "_top", F.coalesce(F.lead("_block").over(order), F.min("_block").over(whole)).alias("_to"))
    sent = placed.join(F.broadcast(tops), "_block")
    copies = F.when(
        F.col("doc_id").eqNullSafe(F.col("_top")),
        F.array(F.struct(F.col("_block").alias("g"), F.lit(False).alias("x")), F.struct(F.col("_to").alias("g"), F.lit(True).alias("x"))),
    ).otherwise(F.array(F.struct(F.col("_block").alias("g"), F.lit(False).alias("x"))))
    return sent.select("doc_id", "text", F.explode(copies).alias("_at")).select("doc_id", "text", "_at.g", "_at.x")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text (the last third
    replaced by the start of the next document), and their likeness."""
    w = Window.partitionBy("g").orderBy("x", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    third = F.floor(F.length("text") / 3).cast("int")
    df = with_next(docs).withColumn("_next", F.coalesce(F.lead("text").over(w), F.lit("")))
    df = df.withColumn(
        "edited", F.concat(F.substr("text", F.lit(1), F.length("text") - third), F.substr("_next", F.lit(1), third))
    ).drop("_next")
    df = fingerprint(fingerprint(df, "text", "fp"), "edited", "fp_edited")
    df = df.withColumn("fp_next", F.lead("fp").over(w)).where(~F.col("x"))
    return df.select(
        "doc_id",
        "text",
        "edited",
        as_text("fp").alias("fingerprint"),
        as_text("fp_edited").alias("edited_fingerprint"),
        likeness("fp", "fp_edited").alias("near_edited"),
        likeness("fp", "fp_next").alias("near_next"),
    )
