"""Mixing sources to target weights by Pfair scheduling, DataFrame functions only.

A source's documents, in doc_id order, are cut into blocks of ``block_chars``
characters.  Weights are whole parts of about 2^28 in all.  Block j of a source
with share w of the parts is released at slot floor(j / w) and due by slot
ceil((j + 1) / w); every slot takes the released block that is due first.  The
shares add up to 1, so no slot is idle and no block is late, and after any t
slots every source has sent t * w blocks, off by less than one, whatever the
number of sources.

The sequence of slots is cut into chunks.  What one chunk hands to the next is
the number of blocks that each source has sent.  All chunks run at once from an
assumed state: floor(t * w) blocks a source, and one more for those whose block
in progress is due first.  A chunk whose assumed state is not what the chunk
before it ends with runs again from that, until no state changes; the fixed
point is the schedule from slot 0.  Two runs that start apart meet once the
blocks they differ in are due, so few chunks run a third time.  A state has one
number a source, so the sources, unlike blocks and chunks, must fit in a row.

Every document comes out at least once; a source that ends early starts again
(``epoch`` 1, 2, ...) until the last source has sent all its blocks.  Sources
of weight 0 come once, after all others.

A null source is a source of its own.  Documents without an id come first,
equal ids by length.  Null texts have 0 characters.  A document longer than a
block takes the slots of all blocks it fills and is listed at the first one.
Repeated rows stay.  An empty table gives an empty mixture.  Other columns are
not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import bucket_of, buckets_for, freeze, id_bounds

PARTS = 1 << 28  # of all weights, about
CHUNK = 1024  # slots a chunk has at least; four a source where that is more
BLOCK_CHARS = 1 << 16
TEMPER = 0.9  # default weights: share of characters to this power


def _source(c: str = "source") -> Column:
    return F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(c)))


def place_in_blocks(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, _source, n, ``block``: running characters of a source, as sums
    over id buckets and then within one bucket, so a hot source is split."""
    count = buckets_for(docs.sparkSession)
    rows = docs.select("doc_id", _source().alias("_source"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"))
    bounds = F.broadcast(id_bounds(docs.select("doc_id"), "doc_id", count))  # one row of at most `count` numbers
    rows = freeze(
        rows.crossJoin(bounds).select("doc_id", "_source", "n", bucket_of(F.col("doc_id"), F.col("_bounds"), count).alias("_g")), "mix-rows"
    )
    sums = rows.groupBy("_source", "_g").agg(F.sum("n").alias("_sum"))
    by_bucket = Window.partitionBy("_source").orderBy("_g")  # at most `count` rows a source
    before = sums.select("_source", "_g", (F.sum("_sum").over(by_bucket) - F.col("_sum")).alias("_before"))
    inside = Window.partitionBy("_source", "_g").orderBy(F.col("doc_id").asc_nulls_first(), "n").rowsBetween(Window.unboundedPreceding, 0)
    at = F.col("_before") + F.sum("n").over(inside) - F.col("n")
    return rows.join(before, ["_source", "_g"]).select("doc_id", "_source", "n", at.alias("at"), F.floor(at / block_chars).alias("block"))


def target_parts(placed: DataFrame, weights: dict[str | None, float] | None = None) -> DataFrame:
    """_source, parts: whole parts of about ``PARTS``, 1 at least for a weight
    above 0."""
    sizes = placed.groupBy("_source").agg(F.sum("n").alias("_n"))
    if weights is None:
        w = F.pow(F.greatest(F.col("_n"), F.lit(1)).cast("double"), TEMPER)
    else:
        w = F.lit(0.0)
        for name, value in weights.items():
            key = "-" if name is None else f"+{name}"
            w = F.when(F.col("_source") == key, F.lit(float(value))).otherwise(w)
    sizes = sizes.withColumn("_w", w)
    total = sizes.agg(F.sum("_w").alias("_all"))  # one row
    share = F.coalesce(F.try_divide(F.col("_w"), F.col("_all")), F.lit(0.0)) * PARTS
    parts = F.when(F.col("_w") > 0, F.greatest(F.lit(1), F.round(share))).otherwise(0)
    return sizes.crossJoin(F.broadcast(total)).select("_source", parts.cast("long").alias("parts"))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _job(j: Column, i: Column) -> Column:
    """Block j of source number i, in the order in which blocks are picked."""
    parts = F.get("parts", i)
    due = _div((j + 1) * F.col("all") + parts - 1, parts)
    return F.struct(due.alias("due"), _div(j * F.col("all"), parts).alias("released"), i.alias("i"), j.alias("j"))


def assumed_state(t: Column) -> Column:
    """Blocks that each source may have sent before slot t: the whole ones, and
    one more of the sources whose block in progress is due first."""
    whole = F.transform("parts", lambda p: _div(t * p, F.col("all")))

    def add(whole: Column) -> Column:
        open_ = F.filter(F.transform(whole, _job), lambda x: F.pmod(t * F.get("parts", x["i"]), F.col("all")) > 0)
        more = (t - F.aggregate(whole, F.lit(0).cast("bigint"), lambda a, n: a + n)).cast("int")
        first = F.transform(F.slice(F.sort_array(open_), F.lit(1), more), lambda x: x["i"])
        return F.transform(whole, lambda n, i: n + F.when(F.array_contains(first, i), 1).otherwise(0))

    return F.transform(F.array(whole), add)[0]


def _run_chunks(chunks: DataFrame) -> DataFrame:
    """Earliest deadline first from ``sent``: ``picks`` (i, j) of every slot of
    the chunk and ``end``, what each source has sent after it."""
    kind = "array<struct<i:int,j:bigint>>"

    def slot(state: Column, t: Column) -> Column:
        def fill(pick: Column) -> Column:
            jobs = F.transform(state["jobs"], lambda x: F.when(x["i"] == pick["i"], _job(x["j"] + 1, x["i"])).otherwise(x))
            return F.struct(jobs.alias("jobs"), F.concat(state["picks"], F.array(F.struct(pick["i"], pick["j"])).cast(kind)).alias("picks"))

        first = F.array_min(F.filter(state["jobs"], lambda x: x["released"] <= t))
        return F.transform(F.array(first), fill)[0]

    start = F.struct(F.transform("sent", _job).alias("jobs"), F.array().cast(kind).alias("picks"))
    slots = F.sequence(F.col("chunk") * F.col("length"), (F.col("chunk") + 1) * F.col("length") - 1)
    done = F.aggregate(slots, start, slot)
    out = chunks.withColumn("_done", done)
    return out.select("chunk", "sent", F.transform("_done.jobs", lambda x: x["j"]).alias("end"), "_done.picks")


def schedule(parts: DataFrame, slots: int) -> DataFrame:
    """_source, q, slot: which block of which source each of the first ``slots``
    slots, or some more, sends.  ``parts``: _source, parts, all above 0."""
    spark = parts.sparkSession
    one = parts.groupBy().agg(F.sort_array(F.collect_list(F.struct("_source", "parts"))).alias("s"), F.sum("parts").alias("all"))
    one = one.select(
        F.transform("s", lambda x: x["_source"]).alias("names"),
        F.transform("s", lambda x: x["parts"]).alias("parts"),
        "all",
        F.greatest(F.lit(CHUNK), 4 * F.size("s")).cast("bigint").alias("length"),
    )
    one = F.broadcast(freeze(one, "mix-sources"))  # one row, one number a source
    chunks = spark.range(-(-slots // CHUNK)).withColumnRenamed("id", "chunk").crossJoin(one).where(F.col("chunk") * F.col("length") < slots)
    run = freeze(_run_chunks(chunks.withColumn("sent", assumed_state(F.col("chunk") * F.col("length")))), "mix-run")
    runs, states = [run.withColumn("round", F.lit(0))], run.select("chunk", "sent", "end", F.lit(0).alias("round"))
    while True:
        before = states.select((F.col("chunk") + 1).alias("chunk"), F.col("end").alias("_true"))
        wrong = states.join(before, "chunk").where(F.col("sent") != F.col("_true")).select("chunk", F.col("_true").alias("sent"))
        run = freeze(_run_chunks(wrong.crossJoin(one)), "mix-run")
        if run.isEmpty():
            break
        no = len(runs)
        runs.append(run.withColumn("round", F.lit(no)))
        new = run.select("chunk", "sent", "end", F.lit(no).alias("round"))
        states = freeze(states.join(new, "chunk", "left_anti").unionByName(new), "mix-states")
    every = reduce(DataFrame.unionByName, runs).join(states.select("chunk", "round"), ["chunk", "round"])
    picks = every.crossJoin(one).select("names", (F.col("chunk") * F.col("length")).alias("_from"), F.posexplode("picks").alias("_at", "x"))
    return picks.select(F.get("names", F.col("x.i")).alias("_source"), F.col("x.j").alias("q"), (F.col("_from") + F.col("_at")).alias("slot"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, source, block, epoch, slot, at (characters before it in its
    source), n_chars; the mixture's order is (slot, at, doc_id)."""
    placed = freeze(place_in_blocks(docs, block_chars), "mix-placed")
    parts = freeze(target_parts(placed, weights), "mix-parts")
    blocks = placed.groupBy("_source").agg((F.max("block") + 1).alias("blocks"))
    plan = freeze(parts.join(blocks, "_source"), "mix-plan")
    some = plan.where("parts > 0")
    total = some.agg(F.sum("parts").alias("all"))  # one row
    # every source's last new block is due by then
    last = some.crossJoin(F.broadcast(total)).agg(F.max(_div(F.col("blocks") * F.col("all") + F.col("parts") - 1, F.col("parts")))).first()[0] or 0
    sends = freeze(schedule(some, last).join(some.select("_source", "blocks"), "_source"), "mix-sends")
    end = sends.where(F.col("q") == F.col("blocks") - 1).agg(F.coalesce(F.max("slot") + 1, F.lit(0).cast("bigint")).alias("end"))
    sends = sends.crossJoin(F.broadcast(end)).where("slot < end")
    sends = sends.select("_source", F.pmod("q", "blocks").alias("block"), _div(F.col("q"), F.col("blocks")).cast("int").alias("epoch"), "slot")
    # sources of weight 0, one after the other
    left = plan.where("parts = 0").groupBy().agg(F.sort_array(F.collect_list(F.struct("_source", "blocks"))).alias("s")).crossJoin(F.broadcast(end))
    before = lambda i: F.aggregate(F.slice("s", F.lit(1), i), F.col("end"), lambda a, x: a + x["blocks"])
    left = left.select(F.explode(F.transform("s", lambda x, i: F.struct(x["_source"], x["blocks"], before(i).alias("_first")))).alias("x")).select("x.*")
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    sends = sends.unionByName(left.select("_source", "block", F.lit(0).alias("epoch"), (F.col("_first") + F.col("block")).alias("slot")))
    source = F.when(F.col("_source") != "-", F.substr("_source", F.lit(2)))
    return placed.join(sends, ["_source", "block"]).select(
        "doc_id", source.alias("source"), "block", "epoch", "slot", "at", F.col("n").alias("n_chars")
    )


def in_mixture_order(docs: DataFrame, mixture: DataFrame) -> DataFrame:
    """``docs`` as the mixture sends them, repeats included, dealt to files by
    ranges of the mixture's order and sorted in each."""
    # repeated rows share the first place of an epoch, so each joins once an epoch
    order = (
        mixture.groupBy(F.col("doc_id").alias("_id"), F.col("n_chars").alias("_n"), "epoch")
        .agg(F.min(F.struct("slot", "at")).alias("_p"))
        .select("_id", "_n", F.col("_p.slot").alias("_slot"), F.col("_p.at").alias("_at"))
    )
    same = docs["doc_id"].eqNullSafe(order["_id"]) & (F.coalesce(F.length(docs["text"]), F.lit(0)).cast("long") == order["_n"])
    keys = ["_slot", "_at", "_id"]
    return docs.join(order, same).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_id", "_slot", "_at", "_n")
