"""Token counter, truncation, packing against a plain stream of tokens."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import convoweave as cw
from convoweave.plans.training_text import MAX_LENGTH
from convoweave.functions.tokens import token_pattern

EOS = "</s>"


@pytest.mark.parametrize(
    "text,tokens",
    [
        ("end</s>", ["end", "</s>"]),
        ("<|user|>\nhi a<b", ["<|user|>", "hi", "a", "<", "b"]),
        ("<|assistant|>x<|system|>", ["<|assistant|>", "x", "<|system|>"]),
        ("", []),
        (" \n\t ", []),
        ("<|other|>", ["<", "|other|>"]),
    ],
)
def test_markers_are_atoms(spark, text, tokens):
    row = spark.createDataFrame([(text,)], "t string").select(
        cw.tokenize(F.col("t"), EOS).alias("tokens"), cw.token_count(F.col("t"), EOS).alias("n")
    ).first()
    assert (row.tokens, row.n) == (tokens, len(tokens))


def test_markers_of_any_shape(spark):
    df = spark.createDataFrame([("say[END]now [ENDING]",)], "t string")
    tokens = df.select(cw.tokenize(F.col("t"), "[END]", special_tokens=["[ENDING]"])).first()[0]
    assert tokens == ["say", "[END]", "now", "[ENDING]"]


def test_real_tokenizer_plugs_in(spark):
    df = spark.createDataFrame([("a bb",), (None,), ("",)], "t string")
    count = cw.token_counter(lambda texts: [len(t) for t in texts])
    assert [r[0] for r in df.select(count(F.col("t"))).collect()] == [4, None, 0]


def test_truncation_keeps_the_first_tokens(spark):
    df = spark.createDataFrame([("a b c d",), ("a b",), ("a b c",)], "text string")
    rows = cw.truncate_tokens(df, 3, eos=EOS).collect()
    assert [(r.tokens, r.n_tokens, r.truncated) for r in rows] == [
        (["a", "b", "c"], 4, True), (["a", "b"], 2, False), (["a", "b", "c"], 3, False),
    ]
    with pytest.raises(ValueError):
        cw.truncate_tokens(df, 0, eos=EOS)


def test_tokens_are_computed_once_per_row(spark):
    from plan_checks import plan_text

    df = spark.range(3).select(F.col("id").cast("string").alias("text"))
    plan = plan_text(cw.truncate_tokens(df, 2, eos=EOS))
    assert plan.count("regexp_extract_all") == 1


def digest(key, seed=0):
    return hashlib.md5(f"{seed}:pack::{key}".encode()).hexdigest()


@pytest.fixture(scope="module")
def rows(spark):
    lengths = [(i, (i * 7919) % 23) for i in range(300)] + [(300, 500)]
    df = spark.createDataFrame(lengths, "id long, length int").withColumn(
        "tokens", F.transform(F.sequence(F.lit(1), F.greatest("length", F.lit(1))),
                              lambda j: F.concat_ws(".", F.col("id"), j))
    ).withColumn("tokens", F.slice("tokens", 1, F.col("length")))
    return lengths, df


@pytest.mark.parametrize("bits", [0, 2, 10])
@pytest.mark.parametrize("shards,block", [(1, 16), (3, 100)])
def test_packing_is_one_stream_per_shard(rows, shards, block, bits):
    lengths, df = rows
    streams = {}
    starts = {}
    for key, n in sorted(lengths, key=lambda r: digest(r[0])):
        shard = int(digest(key)[:15], 16) % shards
        stream = streams.setdefault(shard, [])
        starts[key] = (shard, len(stream))
        stream += [f"{key}.{j}" for j in range(1, n + 1)]

    placed = cw.pack(df, ["id"], "length", block=block, shards=shards, stretch_bits=bits)
    for r in placed.collect():
        assert (r.shard, r.start) == starts[r.id]
        assert (r.block, r.offset) == divmod(r.start, block)

    found = {(r.shard, r.block): r.tokens for r in cw.pack_blocks(placed, "tokens", block=block).collect()}
    expected = {
        (shard, i // block): stream[i : i + block]
        for shard, stream in streams.items()
        for i in range(0, len(stream), block)
    }
    assert found == expected


@pytest.mark.parametrize("bits", [0, 5, 20])
def test_packing_in_integer_order(rows, bits):
    lengths, df = rows
    placed = cw.pack(
        df, ["id"], "length", block=64, shards=2, order="id", shard=F.col("id") % 2,
        stretch_bits=bits,
    )
    at = [0, 0]
    expected = {}
    for key, n in lengths:
        expected[key] = at[key % 2]
        at[key % 2] += n
    assert {r.id: r.start for r in placed.collect()} == expected


def test_segments_cover_each_row_once(rows):
    lengths, df = rows
    placed = cw.pack(df.drop("tokens"), ["id"], "length", block=16, shards=2)
    covered = {}
    for s in cw.pack_segments(placed, "length", block=16).collect():
        assert s.offset + s.to - getattr(s, "from") <= 16
        covered.setdefault(s.id, []).extend(range(getattr(s, "from"), s.to))
    assert {k: sorted(v) for k, v in covered.items()} == {k: list(range(n)) for k, n in lengths if n}


def test_packed_text_from_conversations(chats):
    df = chats(*[[("user", "w " * n), ("assistant", "a")] for n in range(1, 30)])
    text = cw.sft_text(df, eos=EOS, keep=["id"])
    tokens = sum(r.n_tokens for r in text.rows.collect())
    blocks = cw.packed_text(text, ["id"], block=32, shards=2).collect()
    assert sum(len(b.tokens) for b in blocks) == tokens
    last = {}
    for b in blocks:
        last[b.shard] = max(last.get(b.shard, 0), b.block)
    assert all(len(b.tokens) == 32 for b in blocks if b.block < last[b.shard])


def test_sft_text_rejects_or_raises(chats):
    df = chats([("user", "a"), ("assistant", "b")], [("user", None)])
    text = cw.sft_text(df, eos=EOS, keep=["id"], masked=True)
    assert [r.id for r in text.rows.collect()] == [0]
    assert [r.id for r in text.rejects.collect()] == [1]
    assert text.rows.columns == ["id", "text", "spans", "mask", "tokens", "n_tokens", "truncated"]
    with pytest.raises(Exception, match="without content"):
        cw.sft_text(df, eos=EOS, on_invalid="raise").rows.collect()
    with pytest.raises(ValueError):
        cw.sft_text(df, eos=EOS, on_invalid="ignore")


def test_a_long_conversation_keeps_all_tokens_and_its_mask(chats):
    df = chats([("user", "u " * 3000), ("assistant", "a " * 2996), ("tool", "x"), ("assistant", "b")])
    text = cw.sft_text(df, eos=EOS, keep=["id"], masked=True)
    row = text.rows.first()
    assert row.n_tokens == len(row.tokens) == len(row.mask) == 6002 and not row.truncated
    blocks = sorted(cw.packed_text(text, ["id"], block=1000, shards=1).collect(), key=lambda b: b.block)
    tokens = [t for b in blocks for t in b.tokens]
    mask = [m for b in blocks for m in b.mask]
    assert tokens == row.tokens
    assert [t for t, m in zip(tokens, mask) if m] == ["a"] * 2996 + [EOS, "b", EOS]
    cut = cw.sft_text(df, eos=EOS, keep=["id"], masked=True, max_length=3002).rows.first()
    assert len(cut.tokens) == len(cut.mask) == 3002 and cut.mask == row.mask[:3002] and cut.truncated


def test_a_tokenizer_reaches_truncation_and_packing(chats):
    ids = cw.token_lister(lambda texts: [[len(w) for w in t.split()] for t in texts])
    df = chats([("user", "a bb ccc"), ("assistant", "dddd")])
    text = cw.sft_text(df, eos=EOS, keep=["id"], tokenizer=ids, max_length=4)
    row = text.rows.first()
    assert (row.tokens, row.n_tokens, row.truncated) == ([8, 1, 2, 3], 6, True)
    assert cw.packed_text(text, ["id"], block=8, shards=1).first().tokens == [8, 1, 2, 3]
    with pytest.raises(ValueError):
        cw.sft_text(df, eos=EOS, masked=True, tokenizer=ids)


def test_preference_text_length(chats):
    df = chats([("user", "a"), ("assistant", "w " * 3000)], name="chosen").withColumn(
        "rejected", F.slice("chosen", 1, 1)
    ).withColumn("messages", F.col("chosen"))
    assert len(cw.preference_text(df, eos=EOS, keep=["id"]).rows.first().chosen_tokens) == 3004
    limit = MAX_LENGTH["preference"]
    row = cw.preference_text(df, eos=EOS, keep=["id"], max_length=limit).rows.first()
    assert len(row.chosen_tokens) == 2048 and row.chosen_truncated and not row.rejected_truncated
    assert "messages" not in row.asDict()


def test_default_pattern_is_plain_alternation():
    assert re.fullmatch(token_pattern(EOS), "word") and not re.fullmatch(token_pattern(EOS), "a</s>")
