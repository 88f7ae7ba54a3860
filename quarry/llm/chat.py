"""Chat formatting: prefix-target examples, with DataFrame functions only.

A turn is written as ``### role: text </turn>`` and a line end.  Inside roles
and texts a backslash precedes every backslash, ``###`` and ``</turn>`` (and in
roles every colon), so the template's own marks are the only bare ones and the
text comes back by dropping escapes.

Every assistant turn is one example: its context is the conversation up to and
including that turn's header, its target that reply.  A conversation's text is
written once and an example as its end and loss span, so a conversation of n
turns takes O(n) space, not the O(n^2) of copied prefixes;
:func:`example_texts` builds the copies where they are wanted.

Turns are ordered by ``turn`` (null first), then role and text; repeated rows
are turns of their own.  Null roles and texts are empty.  Rows with a null
conv_id form one conversation.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    c = F.replace(c, F.lit("###"), F.lit("\\###"))
    return F.replace(c, F.lit("</turn>"), F.lit("\\</turn>"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, ``formatted``, and ``examples``, an
    array of (turn_no, context_end, loss_end): code points [0, context_end)
    are context and [context_end, loss_end) the trainable reply."""
    clean = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    head = F.concat(F.lit("### "), F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\:")), F.lit(": "))
    rows = clean.select(
        "conv_id",
        F.struct(
            "turn",
            "role",
            "text",
            F.concat(head, escape(F.col("text")), F.lit(" </turn>\n")).alias("line"),
            F.length(head).alias("head"),
            F.length(escape(F.col("text"))).alias("body"),
        ).alias("t"),
    )
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # ends of lines, running over the turns
    spans = F.aggregate(
        F.col("turns"),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<turn_no:int,context_end:int,loss_end:int>>").alias("found"), F.lit(0).alias("no")),
        lambda a, t: F.struct(
            (a["at"] + F.length(t["line"])).alias("at"),
            F.when(
                t["role"] == ASSISTANT,
                F.concat(
                    a["found"],
                    F.array(
                        F.struct(
                            a["no"].alias("turn_no"),
                            (a["at"] + t["head"]).alias("context_end"),
                            (a["at"] + t["head"] + t["body"]).alias("loss_end"),
                        )
                    ),
                ),
            )
            .otherwise(a["found"])
            .alias("found"),
            (a["no"] + 1).alias("no"),
        ),
        lambda a: a["found"],
    )
    return convs.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["line"]), "").alias("formatted"),
        spans.alias("examples"),
    )


def examples(formatted: DataFrame) -> DataFrame:
    """One row an assistant turn: conv_id, turn_no, context_end, loss_end."""
    return formatted.select("conv_id", F.explode("examples").alias("e")).select("conv_id", "e.*")


def with_examples(formatted: DataFrame, rows: DataFrame) -> DataFrame:
    """``formatted`` with the examples that ``rows`` holds, in turn order;
    conversations without one get an empty array."""
    mine = rows.groupBy(F.col("conv_id").alias("_c")).agg(F.sort_array(F.collect_list(F.struct("turn_no", "context_end", "loss_end"))).alias("examples"))
    both = formatted.select("conv_id", "formatted").join(mine, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    none = F.array().cast("array<struct<turn_no:int,context_end:int,loss_end:int>>")
    return both.select("conv_id", "formatted", F.coalesce("examples", none).alias("examples"))


def example_texts(formatted: DataFrame) -> DataFrame:
    """Examples with their whole ``text``; loss on [context_end, loss_end)."""
    cut = formatted.select("conv_id", "formatted", F.explode("examples").alias("e"))
    return cut.select(
        "conv_id", "e.turn_no", "e.context_end", "e.loss_end", F.substr("formatted", F.lit(1), F.col("e.loss_end")).alias("text")
    )


def parse(formatted: DataFrame) -> DataFrame:
    """Reads formatted conversations back: conv_id, ``turns`` (role, text per
    turn), ``loss`` (all trainable text, unescaped), formatted_chars."""
    # the text's own last blank stands before the closing mark's
    found = F.regexp_extract_all("formatted", F.lit(r"(?s)### (?:[^\\:]|\\.)*+: (?:[^\\<]|\\.|<(?!/turn>))*+</turn>\n"), F.lit(0))
    head = r"(?s)^### ((?:[^\\:]|\\.)*+): "
    turn = F.transform(
        found,
        lambda x: F.struct(
            unescape(F.regexp_extract(x, head, 1)).alias("role"),
            unescape(F.regexp_replace(F.regexp_replace(x, head, ""), r" </turn>\n\z", "")).alias("text"),
        ),
    )
    loss = F.transform(
        "examples", lambda e: unescape(F.substr(F.col("formatted"), e["context_end"] + 1, e["loss_end"] - e["context_end"]))
    )
    return formatted.select(
        "conv_id", turn.alias("turns"), F.array_join(loss, "").alias("loss"), F.length("formatted").cast("long").alias("formatted_chars")
    )
