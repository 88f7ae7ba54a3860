"""Quality classifier: interpolated modified Kneser-Ney character trigrams.

Each language has a model of the trusted texts (labelled quality 1), trained
on all of them.  Counts are gathered by joins and sums that are sharded by
n-gram; documents meet the model as sparse rows (n-gram; document, count) that
join the scored n-grams, and partial sums of log probability flow back to
their documents.  A document's perplexity is compared with language-specific
quantiles of the trusted documents' perplexities, from below as well: text
that is too predictable is no prose.  Repetition is predictable only from
itself: the share of different n-grams in a document (its variety) is held
against that of the trusted documents.  The root of its negative logarithm
grows in proportion to the logarithm of the size, so one line a language, fitted
to the medians of the powers of two, and a high quantile of the distances from
it, in units of the spread expected at a size (NOISE, and the chance of few
counts), bound every size, also those without trusted documents.  A line leans on
that of all languages as if ``POOLED`` more documents lay on it, so a language
with few trusted documents is bounded too.

Orders 3, 2, 1 back off to a uniform character.  The top order counts
occurrences, the lower ones different left neighbours; discounts D1, D2, D3+
come from counts of counts at each order.  Character 0 stands before and after
a text.  Nearly all word n-grams of these corpora occur once; characters keep
the model small beside the corpus and see spelling, case and symbols.

Null and empty texts have no perplexity and are rejected.  A language without
trusted text judges nothing: its documents are kept, with null perplexity and,
to read only, the least variety of all languages' line.
Null is a language of its own.  Every row gives one row; repeated rows stay.
Labels without a match do nothing; a document is trusted if any of its label
rows has quality 1.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import BROADCAST_IDS, freeze, lean

LOW, HIGH = 0.001, 0.999  # quantiles of the trusted documents, widened by:
MARGIN = 0.02  # of the log perplexity
VARIETY_MARGIN = 0.1  # of the log share of different n-grams
POOLED = 30  # documents that the line of all languages counts as in a language's fit
NOISE = 0.05  # spread of the root in long texts
SLOPE, SLOPE_WEIGHT = 0.25, 1.0  # of prose; decides where trusted documents have one size
_CHARS = 1 << 21  # characters whose n-grams are sent together
_STEP = 1 << 18  # of them, characters whose places are held at once
_SUMS = 1 << 21  # partial sums a task holds before it sends them on
_BITS = 21


def trusted_docs(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """lang, doc_id, text, trusted.  The ids are broadcast up to a count."""
    good = labels.where("quality = 1").select("doc_id").distinct().withColumn("trusted", F.lit(True))
    good = freeze(good, "kn-trusted")
    side = F.broadcast(good) if good.count() <= BROADCAST_IDS else good
    lang = F.when(F.col("lang").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("lang")))
    return docs.select("doc_id", lang.alias("lang"), "text").join(side, "doc_id", "left").select(
        "lang", "doc_id", "text", F.coalesce("trusted", F.lit(False)).alias("trusted")
    )


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, pd.DataFrame]]:
    """Rows of one language, up to about ``_CHARS`` characters."""
    for whole in batches:
        whole["text"] = whole["text"].fillna("")
        for lang, b in whole.groupby("lang", sort=True):
            cut = (b["text"].str.len().cumsum() // _CHARS).to_numpy()
            for c in np.unique(cut):
                yield lang, b[cut == c]


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(document index, trigram) of every place of every non-empty text."""
    joined = "\0\0" + "\0\0\0".join(texts) + "\0"
    c = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    gram = (c[:-2] << (2 * _BITS)) | (c[1:-1] << _BITS) | c[2:]
    lengths = np.array([len(t) for t in texts]) + 1
    doc = np.repeat(np.arange(len(texts)), lengths)
    # document d starts at 2 + its characters and three marks for each one before
    starts = np.cumsum(lengths) - lengths + 2 * np.arange(len(texts))
    at = np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return doc, gram[at]


def _steps(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """``texts`` in steps of about ``_STEP`` characters, with their first number:
    a place costs some ninety bytes, a different n-gram of a text far fewer."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > _STEP:
            yield at, texts[at:i]
            at, held = i, 0
        held += len(t)
    if at < len(texts):
        yield at, texts[at:]


def _edges(key: np.ndarray) -> np.ndarray:
    """First places of the different values of sorted keys."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))


def count_grams(marked: DataFrame) -> DataFrame:
    """lang, gram, n (in all texts), c (in trusted texts)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lang, b in _slices(batches):
            b = b[b["text"].str.len() > 0]
            if not len(b):
                continue
            trusted, keys, counts = b["trusted"].to_numpy(bool), [], []
            for at, texts in _steps(b["text"].tolist()):
                doc, gram = _trigrams(texts)
                key = np.sort((gram << 1) | trusted[at + doc])
                edge = _edges(key)
                keys.append(key[edge])
                counts.append(np.diff(np.append(edge, len(key))))
            key, n = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(key, kind="stable")
            edge = _edges(key[order])
            n, key = np.add.reduceat(n[order], edge), key[order][edge]
            gram, good = key >> 1, key & 1
            yield pd.DataFrame({"lang": lang, "gram": gram, "n": n, "c": n * good})

    grams = marked.select("lang", "text", "trusted").mapInPandas(lean(run), "lang string, gram long, n long, c long")
    return grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def _discounts(counts: DataFrame, p: str) -> DataFrame:
    """lang, D1, D2, D3 of the counts in column ``n``."""
    n = [F.count_if(F.col("n") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)]
    y = F.coalesce(F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2")), F.lit(0.5))
    d = [
        F.least(F.greatest(F.coalesce(i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")), F.lit(0.5)), F.lit(0.01)), F.lit(i - 0.01))
        for i in (1, 2, 3)
    ]
    return counts.groupBy("lang").agg(*n).select("lang", *[x.alias(f"{p}d{i + 1}") for i, x in enumerate(d)])


def _less(n: Column, p: str) -> Column:
    """Discount of a count."""
    return F.when(n == 1, F.col(f"{p}d1")).when(n == 2, F.col(f"{p}d2")).when(n > 2, F.col(f"{p}d3")).otherwise(0.0)


def _contexts(counts: DataFrame, keys: list[str], p: str) -> DataFrame:
    """Total and freed mass (gamma) of every context."""
    g = counts.join(F.broadcast(_discounts(counts, p)), "lang")  # one row a language
    total = F.sum("n").cast("double")
    return g.groupBy(*keys).agg(total.alias(f"{p}s"), (F.sum(_less(F.col("n"), p)) / total).alias(f"{p}g"), *[F.first(f"{p}d{i}").alias(f"{p}d{i}") for i in (1, 2, 3)])


def score_grams(grams: DataFrame) -> DataFrame:
    """lang, gram, logp for every n-gram of the corpus whose language has a
    model: p(c | a b) from the trusted counts."""
    part = lambda k: F.shiftright("gram", k * _BITS).bitwiseAND((1 << _BITS) - 1)
    every = grams.select("lang", "gram", part(2).alias("a"), part(1).alias("b"), part(0).alias("ch"), "c")
    tri = every.where("c > 0").select("lang", "a", "b", "ch", F.col("c").alias("n"))
    bi = freeze(tri.groupBy("lang", "b", "ch").agg(F.count(F.lit(1)).alias("n")), "kn-bigrams")
    uni = freeze(bi.groupBy("lang", "ch").agg(F.count(F.lit(1)).alias("n")), "kn-unigrams")
    chars = every.groupBy("lang").agg(F.count_distinct("ch").cast("double").alias("v"))
    ctx1 = _contexts(uni, ["lang"], "u").join(chars, "lang")  # one row a language
    ctx2, ctx3 = _contexts(bi, ["lang", "b"], "b"), _contexts(tri, ["lang", "a", "b"], "t")
    named = lambda df, c: df.withColumnRenamed("n", c)
    x = every.join(F.broadcast(ctx1), "lang").join(named(uni, "nu"), ["lang", "ch"], "left")
    x = x.join(named(bi, "nb"), ["lang", "b", "ch"], "left").join(ctx2, ["lang", "b"], "left").join(ctx3, ["lang", "a", "b"], "left")

    def level(n: Column, p: str, lower: Column) -> Column:
        seen = F.coalesce(n, F.lit(0))
        return F.when(F.col(f"{p}s").isNull(), lower).otherwise((seen - _less(seen, p)) / F.col(f"{p}s") + F.col(f"{p}g") * lower)

    p1 = level(F.col("nu"), "u", 1 / F.col("v"))
    x = x.withColumn("p1", p1).withColumn("p2", level(F.col("nb"), "b", F.col("p1")))
    return x.select("lang", "gram", F.log(level(F.col("c"), "t", F.col("p2"))).alias("logp"))


def _sparse(marked: DataFrame) -> DataFrame:
    """lang, gram, batch, docs, counts (packed): the n-grams of every document;
    gram -1 holds a batch's document ids, sizes and trust."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, number = TaskContext.get().partitionId() << 32, 0
        for lang, b in _slices(batches):
            texts = b["text"].tolist()
            some = np.flatnonzero([bool(t) for t in texts])
            sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
            ids = [-1 if pd.isna(d) else int(d) for d in b["doc_id"]]
            types = np.zeros(len(texts), np.int64)
            rows = []
            if len(some):
                parts = []
                for at, step in _steps([texts[i] for i in some]):
                    doc, gram = _trigrams(step)
                    known, code = np.unique(gram, return_inverse=True)
                    key = np.sort(code.astype(np.int64) * len(step) + doc)
                    edge = _edges(key)
                    n = np.diff(np.append(edge, len(key))).astype("<u4")
                    parts.append((known[key[edge] // len(step)], some[at + key[edge] % len(step)].astype("<u2"), n))
                gram, doc, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.argsort(gram, kind="stable")  # a later step has later documents
                gram, doc, n = gram[order], doc[order], n[order]
                types = np.bincount(doc, minlength=len(texts))
                known = gram[_edges(gram)]
                at = np.append(_edges(gram), len(gram))
                small = np.minimum(n, 255).astype(np.uint8)
                docs, counts = doc.tobytes(), small.tobytes()
                rows.append(
                    pd.DataFrame(
                        {
                            "lang": lang,
                            "gram": known,
                            "batch": first + number,
                            "docs": [docs[2 * s : 2 * e] for s, e in zip(at[:-1], at[1:], strict=True)],
                            # counts of 255 and more follow in full after the bytes
                            "counts": [counts[s:e] + n[s:e][n[s:e] >= 255].tobytes() for s, e in zip(at[:-1], at[1:], strict=True)],
                        }
                    )
                )
            none = b["doc_id"].isna().to_numpy(np.int64)
            head = np.stack([np.array(ids, np.int64), sizes, types, b["trusted"].to_numpy(np.int64), none])
            yield pd.DataFrame({"lang": [lang], "gram": [-1], "batch": [first + number], "docs": [head.tobytes()], "counts": [b""]})
            number += 1
            yield from rows

    return marked.mapInPandas(lean(run), "lang string, gram long, batch long, docs binary, counts binary")


def perplexities(marked: DataFrame, scored: DataFrame) -> DataFrame:
    """doc_id, lang, n_grams, n_types (different ones), log_ppl (mean negative
    log probability; null without text or model), trusted."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        langs: dict[int, str] = {}
        held = 0

        def send() -> pd.DataFrame:
            out = pd.DataFrame({"batch": list(sums), "lang": list(langs.values()), "head": False, "data": [s.tobytes() for s in sums.values()]})
            sums.clear()
            langs.clear()
            return out

        for b in batches:
            head = b["gram"].to_numpy() < 0
            if head.any():
                yield pd.DataFrame({"batch": b["batch"][head], "lang": b["lang"][head], "head": True, "data": b["docs"][head]})
            b = b[~head & b["logp"].notna().to_numpy()]
            for batch, g in b.groupby("batch", sort=False):
                doc = np.frombuffer(b"".join(g["docs"]), "<u2").astype(np.int64)
                lens = np.array([len(x) // 2 for x in g["docs"]])
                n = np.concatenate([_counts(c, k) for c, k in zip(g["counts"], lens, strict=True)])
                add = np.bincount(doc, n * np.repeat(g["logp"].to_numpy(), lens))
                old = sums.get(batch)
                if old is None:
                    sums[batch], langs[batch] = add, g["lang"].iloc[0]
                    held += len(add)
                elif len(old) >= len(add):
                    old[: len(add)] += add
                else:
                    add[: len(old)] += old
                    sums[batch] = add
                    held += len(add) - len(old)
            if held > _SUMS:
                yield send()
                held = 0
        if sums:
            yield send()

    def final(b: pd.DataFrame) -> pd.DataFrame:
        ids, sizes, types, trusted, null = np.frombuffer(b.loc[b["head"], "data"].iloc[0], np.int64).reshape(5, -1)
        total = np.zeros(len(ids))
        for s in b.loc[~b["head"], "data"]:
            s = np.frombuffer(s)
            total[: len(s)] += s
        known = (sizes > 0) & (total < 0)
        mean = pd.Series(np.where(known, -total / np.maximum(sizes, 1), np.nan)).astype(object).where(known, None)
        doc = pd.array(ids, "Int64")
        doc[null == 1] = pd.NA
        return pd.DataFrame({"doc_id": doc, "lang": b["lang"].iloc[0], "n_grams": sizes, "n_types": types, "log_ppl": mean.astype("Float64"), "trusted": trusted == 1})

    met = _sparse(marked).join(scored, ["lang", "gram"], "left").select("lang", "gram", "batch", "docs", "counts", "logp")
    sums = met.mapInPandas(lean(partial), "batch long, lang string, head boolean, data binary")
    return sums.groupBy("batch").applyInPandas(final, "doc_id long, lang string, n_grams long, n_types long, log_ppl double, trusted boolean")


def _counts(packed: bytes, k: int) -> np.ndarray:
    n = np.frombuffer(packed, np.uint8, k).astype(np.float64)
    if len(packed) > k:
        n[n == 255] = np.frombuffer(packed, "<u4", offset=k)
    return n


def _lines(points: DataFrame) -> DataFrame:
    """lang, base, slope of the line through the weighted points (x, y, w)."""
    w, x, y = F.col("w"), F.col("x"), F.col("y")
    sums = points.groupBy("lang").agg(F.sum("w").alias("w"), *[F.sum(v).alias(n) for n, v in (("x", w * x), ("y", w * y), ("xx", w * x * x), ("xy", w * x * y))])
    spread = F.greatest(F.col("xx") - x * x / w, F.lit(0.0))
    slope = (F.col("xy") - x * y / w + SLOPE * SLOPE_WEIGHT) / (spread + SLOPE_WEIGHT)
    sums = sums.withColumn("slope", F.greatest(slope, F.lit(0.01)))
    return sums.select("lang", ((y - F.col("slope") * x) / w).alias("base"), "slope")


def _spread(n: Column) -> Column:
    """Expected spread of the root of the negative log variety."""
    return F.sqrt(NOISE * NOISE + 1 / n)


def variety_lines(ppl: DataFrame) -> DataFrame:
    """lang, base, slope, off for every language of ``ppl``: the root of the
    negative log variety is at most base + slope * log size + off spreads.  No
    rows without trusted text."""
    x, y = F.log("n_grams"), F.sqrt(-F.col("variety"))
    good = ppl.where("trusted and log_ppl is not null").select("lang", x.alias("x"), y.alias("y"), F.floor(F.log2("n_grams")).alias("size"))
    middle = [F.percentile_approx(c, 0.5, F.lit(100_000)).alias(c) for c in ("x", "y")]
    own = good.groupBy("lang", "size").agg(*middle, F.count(F.lit(1)).cast("double").alias("w")).drop("size")  # at most 63 rows a language
    pool = good.groupBy("size").agg(*middle, F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(good.agg(F.count(F.lit(1)).alias("all"))))
    pool = pool.select("x", "y", (POOLED * F.col("n") / F.col("all")).alias("w"))
    langs = ppl.select("lang").distinct()
    lines = _lines(own.unionByName(langs.crossJoin(F.broadcast(pool))))
    every = _lines(pool.withColumn("lang", F.lit(""))).select(F.col("base").alias("base0"), F.col("slope").alias("slope0"))  # one row
    off = good.join(F.broadcast(lines), "lang").crossJoin(F.broadcast(every))
    high = lambda base, slope: F.percentile_approx((F.col("y") - F.col(base) - F.col(slope) * F.col("x")) / _spread(F.exp("x")), HIGH, F.lit(100_000))
    mine, all_ = off.groupBy("lang").agg(high("base", "slope").alias("mine")), off.agg(high("base0", "slope0").alias("all"))
    lines = lines.join(F.broadcast(mine), "lang", "left").crossJoin(F.broadcast(all_))
    return lines.select("lang", "base", "slope", F.greatest("mine", "all").alias("off"))


def _least_variety() -> Column:
    """Log variety that a document of ``n_grams`` must reach.  Past the place
    where the line asks for fewer different n-grams the longer a text is, it
    must have as many as there: its start has them already."""
    slope, n = F.col("slope"), F.greatest("n_grams", F.lit(1))
    y = F.greatest(F.col("base") + slope * F.log(n) + F.col("off") * _spread(n), F.lit(0.0))
    turn = F.least(y, 1 / (2 * slope))
    return -(y - turn) / slope - turn * turn - VARIETY_MARGIN


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_grams, perplexity, low, high, variety, least_variety,
    keep for every row."""
    marked = trusted_docs(docs, labels)
    scored = freeze(score_grams(freeze(count_grams(marked), "kn-grams")), "kn-scores")
    ppl = freeze(perplexities(marked, scored), "kn-docs")
    ppl = ppl.withColumn("variety", F.log(F.greatest("n_types", F.lit(1)) / F.greatest("n_grams", F.lit(1))))
    good = ppl.where("trusted and log_ppl is not null")
    q = F.percentile_approx("log_ppl", F.array(F.lit(LOW), F.lit(HIGH)), F.lit(100_000))
    bounds = good.groupBy("lang").agg(q.alias("q"))
    bounds = bounds.select("lang", (F.col("q")[0] * (1 - MARGIN)).alias("lo"), (F.col("q")[1] * (1 + MARGIN)).alias("hi"))
    keep = (F.col("n_grams") > 0) & (
        F.col("log_ppl").isNull() | F.col("lo").isNull() | (F.col("log_ppl").between(F.col("lo"), F.col("hi")) & (F.col("variety") >= F.col("least")))
    )
    lang = F.when(F.col("lang") != "-", F.substr("lang", F.lit(2)))
    # one row a language on either side
    judged = ppl.join(F.broadcast(bounds), "lang", "left").join(F.broadcast(variety_lines(ppl)), "lang", "left").withColumn("least", _least_variety())
    return judged.select(
        "doc_id",
        lang.alias("lang"),
        "n_grams",
        F.exp("log_ppl").alias("perplexity"),
        F.exp("lo").alias("low"),
        F.exp("hi").alias("high"),
        F.exp("variety").alias("variety"),
        F.exp("least").alias("least_variety"),
        keep.alias("keep"),
    )
