"""Rendering, loss spans and the guard, against a plain reading of the format."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import convoweave as cw
from convoweave.functions import chat
from convoweave.plans.training_text import split_invalid

EOS = "</s>"


def plain_render(messages, prompt=False):
    text, spans = "", []
    for i, (role, content) in enumerate(messages):
        last = i == len(messages) - 1
        if role in ("system", "user"):
            text += f"<|{role}|>\n{content}\n"
        elif role == "assistant":
            text += "<|assistant|>\n"
            spans.append((len(text), len(text) + len(content) + len(EOS)))
            text += content + EOS + ("" if last else "\n")
        if last and prompt:
            text += "<|assistant|>\n"
    return text, spans


CASES = [
    [("user", "hi"), ("assistant", "ho")],
    [("system", "s"), ("user", "u"), ("assistant", "a"), ("user", "v")],
    [("user", "u"), ("tool", "t"), ("assistant", "a")],
    [("user", "u"), ("assistant", "a"), ("tool", "t")],
    [("user", "  padded \n\n"), ("assistant", "\nlines\n")],
    [("user", "says <|user|> itself"), ("assistant", "</s>")],
    [("user", "\U0001f600 and ü"), ("assistant", "\U0001f680\U0001f680"), ("user", "é"), ("assistant", "x")],
    [("assistant", "one"), ("assistant", "two")],
    [("user", "only")],
    [("system", "last")],
    [("user", ""), ("assistant", "")],
    [("tool", "t")],
    [],
]


def test_render_and_spans_match_plain_reading(chats):
    m = F.col("messages")
    rows = chats(*CASES).select(
        "id",
        cw.render_chat(m, EOS).alias("text"),
        cw.render_chat(m, EOS, add_generation_prompt=True).alias("prompted"),
        cw.assistant_spans(m, EOS).alias("spans"),
    )
    for row in rows.collect():
        text, spans = plain_render(CASES[row.id])
        assert row.text == text
        assert row.prompted == plain_render(CASES[row.id], prompt=True)[0]
        assert [(s.start, s.end) for s in row.spans] == spans


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.lists(
            st.tuples(
                st.sampled_from(["system", "user", "assistant", "tool"]),
                st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\x00")),
            ),
            max_size=9,
        ),
        min_size=1,
        max_size=20,
    )
)
def test_spans_cover_contents_and_eos(chats, conversations):
    m = F.col("messages")
    rows = chats(*conversations).select(
        "id", cw.render_chat(m, EOS).alias("text"), cw.assistant_spans(m, EOS).alias("spans")
    )
    for row in rows.collect():
        assert row.text == plain_render(conversations[row.id])[0]
        covered = "".join(row.text[s.start : s.end] for s in row.spans)
        assert covered == "".join(
            c + EOS for r, c in conversations[row.id] if r == "assistant"
        )


def test_long_conversation_is_folded_in_slices(chats):
    long = [(("user", "assistant")[i % 2], "x" * (i % 7)) for i in range(1500)]
    spans = chats(long).select(cw.assistant_spans(F.col("messages"), EOS)).first()[0]
    assert [(s.start, s.end) for s in spans] == plain_render(long)[1]


@pytest.mark.parametrize("turn_bits", [0, 1, 3, 12])
def test_turn_spans_equal_array_spans_in_any_stretch(spark, chats, turn_bits):
    df = chats(*CASES)
    turns = df.select("id", F.posexplode("messages").alias("turn", "m")).select(
        "id", "turn", "m.role", "m.content"
    )
    found = cw.turn_spans(turns, eos=EOS, key="id", turn_bits=turn_bits).collect()
    expected = {
        (i, *span) for i, case in enumerate(CASES) for span in plain_render(case)[1]
    }
    assert {(r.id, r.start, r.end) for r in found} == expected


@pytest.mark.parametrize("turn_bits", [0, 1, 12])
def test_rendered_turns_join_to_the_text(chats, turn_bits):
    turns = chats(*CASES).select("id", F.posexplode("messages").alias("turn", "m")).select(
        "id", "turn", "m.role", "m.content"
    )
    texts = {}
    rows = cw.render_turns(turns, eos=EOS, key="id", turn_bits=turn_bits)
    for row in rows.orderBy("id", "turn").collect():
        assert row.start == len(texts.get(row.id, ""))
        texts[row.id] = texts.get(row.id, "") + row.piece
    assert texts == {i: plain_render(case)[0] for i, case in enumerate(CASES) if case}


def test_null_conversation_and_missing_content(chats):
    df = chats(
        None,
        [("user", None), ("assistant", "a")],
        [(None, "x"), ("user", "u")],
        [(None, None), ("tool", None), ("user", "u")],
    )
    m = F.col("messages")
    rows = df.select(
        "id",
        cw.invalid_messages(m).alias("bad"),
        cw.render_chat(m, EOS).alias("text"),
        cw.assistant_spans(m, EOS).alias("spans"),
    ).orderBy("id").collect()
    assert [r.bad for r in rows] == [False, True, False, False]
    assert [r.text for r in rows] == [None, None, "<|user|>\nu\n", "<|user|>\nu\n"]
    assert [r.spans for r in rows] == [None, None, [], []]
    valid, rejects = split_invalid(df, ["messages"])
    assert {r.id for r in valid.collect()} == {2, 3}
    assert {r.id for r in rejects.collect()} == {0, 1}


def test_struct_fields_may_come_in_any_order(spark):
    df = spark.sql("SELECT array(struct('hi' AS content, 'user' AS role)) AS messages")
    assert df.select(cw.render_chat(F.col("messages"), EOS)).first()[0] == "<|user|>\nhi\n"


def test_pairs_render_like_conversations(chats):
    df = chats(*CASES[:3], name="chosen").withColumn("rejected", F.slice("chosen", 1, 1))
    for row in cw.render_pairs(df, EOS).collect():
        assert row.chosen_text == plain_render(CASES[row.id])[0]
        assert row.rejected_text == plain_render(CASES[row.id][:1])[0]


def test_assembled_turns_are_in_turn_order(spark):
    turns = spark.createDataFrame(
        [(1, 10, "user", "c"), (1, 2, "assistant", "b"), (1, 1, "user", "a"), (2, 0, "user", "z")],
        "k int, turn int, role string, content string",
    ).repartition(3)
    rows = {r.k: [m.content for m in r.messages] for r in cw.assemble_messages(turns, key="k").collect()}
    assert rows == {1: ["a", "b", "c"], 2: ["z"]}


def test_marker_lengths_are_those_of_the_text():
    assert {chat.ROLE_MARKERS[r] for r in ("system", "user", "assistant")} == {
        "<|system|>", "<|user|>", "<|assistant|>",
    }


def test_invalid_turns_take_their_conversation_along(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (2, 0, "tool", None), (2, 1, "user", "b"),
            (3, 0, None, None)]
    turns = spark.createDataFrame(rows, "k int, turn int, role string, content string")
    valid, rejects = cw.split_invalid_turns(turns, key="k")
    assert valid.columns == rejects.columns == ["k", "turn", "role", "content"]
    assert sorted((r.k, r.turn) for r in valid.collect()) == [(2, 0), (2, 1), (3, 0)]
    assert sorted((r.k, r.turn) for r in rejects.collect()) == [(1, 0), (1, 1)]
