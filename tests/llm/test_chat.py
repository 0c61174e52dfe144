"""Operator 11: round trips of escapes, ids and masks, conversations in many blocks and partitions, odd rows."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from partledger.llm import chat
from partledger.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
texts = st.lists(st.sampled_from([*chat.MARKS, "<", "[", "\\", "s>", "/s>", "INST]", "ok", " ", "\n", "é", "語", "<\\s>", "[\\\\INST]"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_escape_round_trip(text):
    escape = chat.Escape(chat.MARKS)
    assert escape.taken(escape.put(text)) == text
    assert not any(mark in escape.put(text) for mark in chat.MARKS)


def test_marks_that_could_overlap_are_refused():
    for marks in (("<a<>",), ("<\\s>",), ("<",), ("<a>", "[b<]")):
        with pytest.raises(ValueError, match="mark"):
            chat.Escape(marks)


def parsed(string):
    """The turns of a formatted string, by splitting at marks."""
    escape, turns, name, start = chat.Escape(chat.MARKS), [], "", 0
    role_of = {closing: role for role, (_, closing) in chat.TURNS.items()}
    i = 0
    while i < len(string):
        mark = next((m for m in chat.MARKS if string.startswith(m, i)), None)
        if mark is None:
            i += 1
            continue
        text = escape.taken(string[start:i])
        i = start = i + len(mark)
        if mark == "[/ROLE]":
            name = text
        elif mark == "[/TURN]" or mark in role_of:
            turns.append((role_of.get(mark, name), text))
    return turns


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[/ROLE]x"]), texts), max_size=6))
def test_ids_and_masks_round_trip(turns):
    formats = chat.formatter(chat.VOCABULARY).build()
    block = chat.Block(1, 0)
    for role, text in turns:
        block.add(role, *formats.turn(role, text))
    ids = np.array([i for piece in block.ids for i in piece], np.int32)
    read, loss, chars = formats.read_back(ids, block.mask())
    string = "".join(block.strings)
    assert read == turns == parsed(string) and chars == len(string)
    assert loss == [text for role, text in turns if role == "assistant" and text]
    # Each segment is encoded alone, and only marks have ids beyond the vocabulary.
    assert sum(int(i >= formats.first) for i in ids) == sum({"user": 3, "assistant": 1, "system": 2}.get(role, 3) for role, _ in turns)


def expected(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns = [(role, text) for _, _, role, text in sorted(turns, key=lambda t: (t[0], t[1] or 0, t[2]))]
        spoken, loss = "".join(f"{r}\n{t}\n" for r, t in turns), "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(spoken.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def got(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows}


def conversations():
    rnd = random.Random(4)
    word = lambda: rnd.choice(["ok", "</s>", "[INST]", "a\nb", "é", "<s", "\\"])
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "tool"]), " ".join(word() for _ in range(rnd.randint(0, 9)))) for c in range(40) for t in range(rnd.randint(1, 9))]
    rows += [(7777, t, ("user", "assistant")[t % 2], f"turn {t} " + "long " * 40) for t in range(900)]  # a conversation of most rows
    rows += [(50, None, "user", "first"), (50, 0, None, "x"), (50, 1, "assistant", None), (None, 0, "assistant", "no id"), (None, 1, "user", ""), (51, 0, "user", "twice"), (51, 0, "user", "twice"), (52, 3, "assistant", "b" * 300000)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("held", "block"), [(chat.HELD_BYTES, chat.BLOCK_TOKENS), (200, 64)])
def test_conversations_over_blocks_and_partitions(spark, monkeypatch, held, block):
    monkeypatch.setattr(chat, "HELD_BYTES", held)
    rows = conversations()
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("ids", F.lit("x")).withColumn("part", F.lit(1))
    blocks = chat.format_conversations(docs.repartition(5), block_tokens=block)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else these few rows are one partition
    try:
        out = blocks.collect()
        assert got(chat.digests(blocks, chat.VOCABULARY)) == expected(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r.n_turns for r in out) == len(rows) and all(len(r.ids) == len(r.loss_mask) for r in out)
    assert len({r.part for r in out if r.conv_id == 7777}) > 1  # no one task has the large conversation
    strings = {}
    for r in sorted(out, key=lambda r: (r.part, r.place)):
        strings[r.conv_id] = strings.get(r.conv_id, "") + r.text
    assert {c: len(parsed(s)) for c, s in strings.items()} == {c: e[0] for c, e in expected(rows).items()}


def test_empty_table_and_query(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.format_conversations(empty).count() == 0 and chat.digests(chat.format_conversations(empty), chat.VOCABULARY).count() == 0
    empty.write.parquet(f"file://{tmp_path}/conversations.parquet")
    row = QUERIES["op11_format_chat"](spark, f"file://{tmp_path}").first()
    text = chat.HOSTILE
    assert (row.conv_id, row.n_turns, row.loss_chars) == (-1, 2, len(text)) and row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert row.formatted_chars == 2 * (len(text) + 3) + 20
