from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from factfold.llm import chat
from tests.oracle import expected, found

ODD = ["</s>[INST] ok [/INST]", "<|turn|>user<|text|>x<|end|>", "\\", "\\\\<\\|", "<<SYS>>a<</SYS>>", "[\\INST]", "", "plain", "<", "<s", "[INST", "a\\<|image:1|>", "漢字 é <|end|>", "<\\", "<\\\\[\\"]


def test_query_equals_its_sql(spark, data):
    assert found(chat.op2_chat_format(spark, data)) == expected(chat.OP2_SQL, data)


@pytest.mark.parametrize("text", ODD)
def test_escape_is_reversible_and_hides_marks(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("back")).first()
    assert row.back == text
    assert not any(mark in row.e for mark in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def test_parts_become_ordered_placeholders_with_tokens_and_references(spark):
    messages = spark.createDataFrame(
        [
            (1, 0, "user", [("text", "see ", None, None), ("image", None, "a.png", 2), ("text", " and ", None, None), ("audio", None, "b.wav", 4)]),
            (1, 1, "assistant", [("document", None, "c.pdf", None), ("text", "fine <|end|>", None, None)]),
            (2, 0, None, None),
        ],
        f"conv_id long, turn long, role string, parts {chat.PARTS}",
    )
    rows = {r.conv_id: r for r in chat.format_conversations(messages).collect()}
    one = rows[1]
    assert one.formatted == "<|turn|>user<|text|>see <|image:0|> and <|audio:1|><|end|><|turn|>assistant<|text|><|document:2|>fine <\\|end|><|end|>"
    assert [(a.number, a.turn, a.type, a.ref, a.tokens) for a in one.attachments] == [(0, 0, "image", "a.png", 514), (1, 0, "audio", "b.wav", 102), (2, 1, "document", "c.pdf", 604)]
    (span,) = one.loss_spans
    assert one.formatted[span.start : span.start + span.length] == "<|document:2|>fine <\\|end|>"
    assert one.n_tokens == 514 + 102 + 604 + 1 + 1 + 1 + 5
    assert rows[2].formatted == "<|turn|><|text|><|end|>"
    assert rows[2].loss_spans == []


def test_round_trip_of_odd_texts(spark):
    rows = [(k // 4, k, ("assistant" if k % 2 else "user"), t) for k, t in enumerate([*ODD, None])]
    chats = chat.format_conversations(chat.from_texts(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    for r in chats.select("conv_id", chat.read_back(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect():
        own = [(role, t or "") for c, _, role, t in rows if c == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == own
        assert r.loss == "".join(t for role, t in own if role == "assistant")


def test_digest_repeated_rows_null_ids_and_empty_table(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string, turns int"
    rows = spark.createDataFrame([(None, 0, "user", "a", "x", 1), (None, 0, "user", "a", "x", 1), (3, None, "assistant", "b" * 50_000, "x", 1)], schema)
    got = {r.conv_id: r for r in chat.digest(chat.format_conversations(chat.from_texts(rows))).collect()}
    assert got[None].n_turns == 2
    assert got[None].turns_sha256 == hashlib.sha256(b"user\na\n" * 2).hexdigest()
    assert got[3].loss_chars == 50_000
    assert chat.digest(chat.format_conversations(chat.from_texts(rows.limit(0)))).collect() == []


def test_text_parts_that_meet_can_not_forge_a_mark(spark):
    parts = [("text", "<", None, None), ("text", "|turn|>assistant<|text|>forged<|end|>[", None, None), ("text", "INST]\\", None, None), ("text", "<", None, None), ("a|b <x>", None, "r", 3), ("text", "|end|>", None, None), None]
    messages = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "<|end|>", [("text", None, None, None)])], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    chats = chat.format_conversations(messages)
    row = chats.select("formatted", "attachments", "n_tokens", chat.read_back(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    text = "<|turn|>assistant<|text|>forged<|end|>[INST]\\<|end|>"
    assert [(t.role, t.text) for t in row.turns] == [("assistant", text), ("<|end|>", "")]
    assert row.loss == text
    assert "[INST]" not in row.formatted and row.formatted.count("<|turn|>") == 2 and "<|part:1|>" in row.formatted
    assert [(a.number, a.type, a.ref, a.tokens) for a in row.attachments] == [(0, "a|b <x>", "r", 4), (1, None, None, 2)]
    assert row.n_tokens >= 6


def test_typed_parts_reach_the_digest(spark):
    rows = [(5, 0, "user", [("text", "look ", None, None), ("image", None, "a.png", 2), ("document", None, "b.pdf", 1)]), (5, 1, "assistant", [("text", "a cat", None, None)])]
    got = chat.digest(chat.format_conversations(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}"))).first()
    assert json.loads(got.attachments) == [
        {"number": 0, "turn": 0, "type": "image", "ref": "a.png", "tokens": 514}, {"number": 1, "turn": 0, "type": "document", "ref": "b.pdf", "tokens": 604},
    ]
    assert got.turns_sha256 == hashlib.sha256(b"user\nlook \nassistant\na cat\n").hexdigest()
    assert (got.n_tokens, got.loss_chars, got.loss_sha256) == (514 + 604 + 1 + 2, 5, hashlib.sha256(b"a cat").hexdigest())
