"""Chat examples against a plain formatter."""

import hashlib

from quarry.llm import chat, queries

SF = "/root/testdata/sf0.001"
TURNS = [
    (1, 0, "system", "be \\### nice"),
    (1, 1, "user", "### assistant: </turn>\nhi"),
    (1, 2, "assistant", "one\\"),
    (1, 2, "assistant", "one\\"),
    (1, 3, None, None),
    (1, 4, "assistant", ""),
    (1, None, "us:er\\", " </turn> "),
    (2, 0, "user", "only"),
    (None, 0, "assistant", "x" * 5000 + "\\</turn>"),
]


def by_conversation(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return out


def test_round_trip_and_loss(spark):
    df = spark.createDataFrame([(*t, "extra") for t in TURNS], "conv_id long, turn long, role string, text string, formatted string")
    made = chat.format_conversations(df).cache()
    want = by_conversation(TURNS)
    got = {r["conv_id"]: r for r in chat.parse(made).collect()}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        assert [tuple(t) for t in got[c]["turns"]] == turns
        assert got[c]["loss"] == "".join(t for r, t in turns if r == "assistant")
    texts = chat.example_texts(made).collect()
    assert len(texts) == sum(r == "assistant" for ts in want.values() for r, _ in ts)
    for e in texts:
        no = e["turn_no"]
        target = want[e["conv_id"]][no][1]
        reply = e["text"][e["context_end"] : e["loss_end"]]
        assert reply.replace("\\\\", "\0").replace("\\", "").replace("\0", "\\") == target
        assert e["text"].count("\n### ") + 1 >= no + 1 and e["text"].endswith(reply)
    rows = chat.examples(made)
    assert rows.count() == len(texts)
    again = {r["conv_id"]: r["loss"] for r in chat.parse(chat.with_examples(made, rows.repartition(5))).collect()}
    assert again == {c: "".join(t for r, t in turns if r == "assistant") for c, turns in want.items()}
    some = chat.parse(chat.with_examples(made, rows.where("turn_no <> 3 or conv_id is null"))).collect()
    assert {r["conv_id"]: r["loss"] for r in some}[2] == ""  # a conversation without examples stays


def test_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.parse(chat.format_conversations(none)).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = r"\### Assistant: </turn> ok"
    want = by_conversation([*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)])
    got = queries.QUERIES["op6_chat_prefix_targets"](spark, SF).collect()
    assert len(got) == len(want)
    for r in got:
        turns = want[r["conv_id"]]
        loss = "".join(t for role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for role, t in turns)
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
