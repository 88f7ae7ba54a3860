"""Personal data by bootstrapped contextual extraction, DataFrame functions only.

Four fixed forms (email, ip, card, phone) are the seeds.  Words with a digit
or ``@`` are candidate identifiers; the word before and the word after a
candidate are its lexical patterns.  On the graph of patterns and identifiers,
a pattern's score is the believed share of everything that stands in its place
in the corpus, and an identifier's the noisy-or of its patterns; both are
updated in ``ROUNDS`` rounds.  Patterns of high score and enough different
seeds then add the candidates beside them as spans of kind ``context``.  A
common word is no pattern: most of what follows it is no identifier.

Positions are code points, ends exclusive.  Every row gives one row; null and
empty texts have no spans; repeated rows stay.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import freeze

KINDS = ("email", "ip", "card", "phone")
#: Fixed forms, written without backtracking.  The look-behinds only skip
#: starts inside a run that has failed already (\G: right after a match).
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
_NEAR = 64  # code points beside a candidate in which its neighbour word lies
ROUNDS = 3
MIN_SEEDS = 5  # different seeds a pattern needs
MIN_SCORE = 0.5


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(c: Column) -> Column:
    back = F.reverse(c)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(back, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), F.lit(0), add) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(
            F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("bigint"), F.lit(0)) <= 255
        )
    if kind == "card":
        d = _digits(m)
        return F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _placed(text: str, form: str, matches: str) -> Column:
    """(start, before, match, after) of each match: the pieces between matches
    give the places.  Only rows with a match are split."""
    pieces = F.split(F.col(text), form, -1)
    step = lambda a, x: F.struct(
        (a["at"] + F.length(x["piece"]) + F.length(x["match"])).alias("at"),
        F.concat(
            a["out"],
            F.array(
                F.struct(
                    (a["at"] + F.length(x["piece"])).alias("start"),
                    F.substr(x["piece"], F.greatest(F.length(x["piece"]) - _NEAR + 1, F.lit(1)), F.lit(_NEAR)).alias("before"),
                    x["match"].alias("match"),
                    F.substr(x["next"], F.lit(1), F.lit(_NEAR)).alias("after"),
                )
            ),
        ).alias("out"),
    )
    zipped = F.transform(
        F.array(pieces),
        lambda p: F.transform(
            F.col(matches),
            lambda m, i: F.struct(F.get(p, i).alias("piece"), m.alias("match"), F.get(p, i + 1).alias("next")),
        ),
    )[0]
    kind = "array<struct<start:int,before:string,match:string,after:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    return F.when(F.size(matches) > 0, F.aggregate(zipped, start, step, lambda a: a["out"])).otherwise(F.array().cast(kind))


def _before(c: Column) -> Column:
    """Last word of a text's end, lower case; empty if none."""
    return F.lower(F.substring_index(F.rtrim(F.translate(c, "\n\t\r\f\x0b", "     ")), " ", -1))


def _after(c: Column) -> Column:
    return F.lower(F.substring_index(F.ltrim(F.translate(c, "\n\t\r\f\x0b", "     ")), " ", 1))


def _base_spans(no: int, kind: str) -> Column:
    good = F.filter(_placed("text", FORMS[kind], f"_m_{kind}"), lambda x: valid(kind, x["match"]))
    return F.transform(
        good,
        lambda x: F.struct(
            x["start"].alias("start"), F.lit(no).alias("no"), F.lit(kind).alias("kind"), (x["start"] + F.length(x["match"])).alias("end")
        ),
    )


def seeds_and_candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base spans (start, no, kind, end) and candidates (start, end,
    token, left, right, seed) of every document, frozen with a row id."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for k, form in FORMS.items():
        df = df.withColumn(f"_m_{k}", F.regexp_extract_all("text", F.lit(form), F.lit(0)))
    df = df.withColumn("_m_c", F.regexp_extract_all("text", F.lit(_CANDIDATE), F.lit(0)))
    for no, k in enumerate(KINDS):
        df = df.withColumn(f"_s_{k}", _base_spans(no, k))
    df = df.withColumn("base", F.sort_array(F.concat(*[F.col(f"_s_{k}") for k in KINDS])))
    cands = F.transform(
        _placed("text", _CANDIDATE, "_m_c"),
        lambda x: F.struct(
            x["start"].alias("start"),
            (x["start"] + F.length(x["match"])).alias("end"),
            F.xxhash64(x["match"]).alias("token"),
            F.xxhash64(F.lit("<"), _before(x["before"])).alias("left"),
            F.xxhash64(F.lit(">"), _after(x["after"])).alias("right"),
            F.exists(F.col("base"), lambda b: (b["start"] < x["start"] + F.length(x["match"])) & (b["end"] > x["start"])).alias("seed"),
        ),
    )
    return freeze(df.select("doc_id", "base", cands.alias("cands")).withColumn("_row", F.monotonically_increasing_id()), "pii-seeds")


def pattern_scores(found: DataFrame, docs: DataFrame) -> DataFrame:
    """pattern, score, seeds: the pattern-identifier graph, scored in rounds."""
    c = found.select(F.explode("cands").alias("c")).select("c.token", "c.seed", F.explode(F.array("c.left", "c.right")).alias("pattern"))
    edges = c.groupBy("pattern", "token").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed"))
    seeded = edges.where("seed").groupBy("pattern").agg(F.count(F.lit(1)).alias("seeds")).where(F.col("seeds") >= MIN_SEEDS)
    seeded = freeze(seeded, "pii-patterns")
    edges = freeze(edges.join(seeded, "pattern", "left_semi"), "pii-edges")
    # how often each pattern's word stands beside anything, in the whole corpus
    blank = F.lit(" \t\n\x0b\x0c\r")
    words = docs.select(F.explode(F.split(F.lower(F.btrim(F.coalesce("text", F.lit("")), blank)), r"\s+")).alias("w"))
    places = words.groupBy("w").agg(F.count(F.lit(1)).alias("_places")).select(
        F.explode(F.array(F.xxhash64(F.lit("<"), "w"), F.xxhash64(F.lit(">"), "w"))).alias("pattern"), "_places"
    )
    patterns = freeze(seeded.join(places.groupBy("pattern").agg(F.sum("_places").alias("places")), "pattern", "left"), "pii-places")
    tokens = edges.groupBy("token").agg(F.max("seed").cast("double").alias("belief"))
    for _ in range(ROUNDS):
        believed = edges.join(tokens, "token").groupBy("pattern").agg(F.sum(F.col("n") * F.col("belief")).alias("_b"), F.sum("n").alias("_n"))
        scores = freeze(
            patterns.join(believed, "pattern").select(
                "pattern", "seeds", (F.col("_b") / (F.greatest(F.coalesce("places", F.lit(0)), F.col("_n")) + 1)).alias("score")
            ),
            "pii-scores",
        )
        miss = F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9))))
        tokens = edges.join(scores, "pattern").groupBy("token").agg(
            F.when(F.max("seed"), F.lit(1.0)).otherwise(1 - F.exp(miss)).alias("belief")
        )
    return scores


def find(docs: DataFrame) -> DataFrame:
    """doc_id, ``base`` and ``spans`` (base and discovered, by start)."""
    found = seeds_and_candidates(docs)
    good = pattern_scores(found, docs).where(F.col("score") >= MIN_SCORE).select("pattern")
    unseen = found.select("_row", F.explode(F.filter("cands", lambda c: ~c["seed"])).alias("c"))
    unseen = unseen.select("_row", "c.start", "c.end", F.explode(F.array("c.left", "c.right")).alias("pattern"))
    more = unseen.join(good, "pattern", "left_semi").groupBy("_row").agg(
        F.collect_set(F.struct("start", F.lit(len(KINDS)).alias("no"), F.lit("context").alias("kind"), "end")).alias("more")
    )
    spans = F.sort_array(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:int,no:int,kind:string,end:int>>"))))
    return found.join(more, "_row", "left").select("doc_id", "base", spans.alias("spans"))


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
