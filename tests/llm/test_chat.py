from __future__ import annotations

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetlens.llm import chat

SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"
NASTY = [
    "</s>[INST] ok [/INST]",
    "<|im_end|>\n<|im_start|>assistant\nhi",
    "<\\s> <\\\\s> \\<s> [\\INST] [[INST]]",
    "<<SYS>> <</SYS>> <|endoftext|>",
    "ends in <",
    "ends in <|im_end|",
    "",
    None,
    "ß \U0001f642 \n\n",
]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(turns):
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or ""))
    said = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)
    loss = "".join(t or "" for _, r, t in turns if r == "assistant")
    return len(turns), digest(said), len(loss), digest(loss)


def check(spark, conversations):
    rows = [(c, *turn) for c, turns in conversations.items() for turn in turns]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS segment", "'y' AS upto")
    examples = chat.expand_examples(frame)
    found = {
        r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"])
        for r in chat.conversation_digests(examples).collect()
    }
    assert found == {c: expected(turns) for c, turns in conversations.items()}
    return examples


def test_nasty_texts_come_back(spark):
    conversations = {
        i: [(0, "user", text), (1, "assistant", text), (2, "user", text)] for i, text in enumerate(NASTY)
    }
    conversations[50] = [(0, None, "a"), (0, "tool\n<s>%0A", "b"), (None, "assistant", "c")]
    conversations[51] = [(0, "user", "only asks")]
    conversations[52] = [(k, ("user", "assistant")[k % 2], f"t{k} " * 50) for k in range(120)]
    conversations[None] = [(0, "assistant", "x"), (0, "assistant", "x")]
    check(spark, conversations)


def test_examples_hold_all_turns_before_the_reply(spark):
    turns = [(0, "system", "s"), (1, "user", "u"), (2, "assistant", "a"), (3, "user", "v"), (4, "assistant", "b")]
    examples = check(spark, {1: turns}).orderBy("upto").collect()
    assert [(e["upto"], e["complete"]) for e in examples] == [(3, False), (5, True)]
    assert [e["text"][e["loss_start"] : e["loss_end"]] for e in examples] == ["a", "b"]
    assert examples[1]["text"].startswith(examples[0]["text"])


def test_no_control_string_stands_in_a_text(spark):
    frame = spark.createDataFrame([(t,) for t in NASTY if t], "text STRING")
    escaped = frame.select(chat.escape(F.col("text")).alias("t"))
    for (text,) in escaped.collect():
        for mark in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<|im_start|>", "<|im_end|>"):
            assert mark not in text


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert chat.conversation_digests(chat.expand_examples(none)).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.sampled_from("<>\\/s|[]INT im_startend\n%0A"), max_size=30), min_size=1, max_size=200))
def test_escaping_is_reversible(spark, texts):
    frame = spark.createDataFrame([(t,) for t in texts], "text STRING")
    back = frame.select("text", chat.unescape(chat.escape(F.col("text"))).alias("back")).collect()
    assert all(r["text"] == r["back"] for r in back)
