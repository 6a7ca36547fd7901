"""Masks of trained tokenizers, against the flag of every code point."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import convoweave as cw
from convoweave.functions.chat import ROLE_MARKERS
from convoweave.functions.encoders import span_mask
from plan_checks import plan_text

public_tokenizers = pytest.importorskip("public_tokenizers")
EOS = "</s>"
ATOMS = (*ROLE_MARKERS.values(), EOS)


def pairs():
    """Tokens of two code points, whatever they are: borders of spans fall inside them."""

    class Pairs:  # local, so that workers get it by value
        def encode(self, texts):
            out = []
            for t in texts:
                starts = list(range(0, len(t), 2))
                out.append(([ord(t[i]) for i in starts], starts, [min(i + 2, len(t)) for i in starts]))
            return out

    return Pairs()


def encoders():
    return [cw.FileTokenizer(public_tokenizers.path(f), ATOMS) for f in ("byte_bpe_50k.json", "word_bpe_49k.json")] + [pairs()]


def plain_mask(text, messages, row):
    """Tokens from the one with the first trained code point of an answer to the one with the last."""
    at, flags = 0, [False] * len(row[0])
    for k, (role, content) in enumerate(messages):
        if role not in ROLE_MARKERS:
            continue
        head = f"{ROLE_MARKERS[role]}\n"
        if role == "assistant":
            lo, hi = at + len(head), at + len(head) + len(content) + len(EOS)
            held = [i for i, (a, b) in enumerate(zip(*row[1:])) if a < hi and b > lo]
            if held:
                flags[held[0] : held[-1] + 1] = [True] * (held[-1] + 1 - held[0])
            at = hi + (k + 1 < len(messages))
        else:
            at += len(head) + len(content) + 1
    assert at == len(text)
    return flags


CHATS = [
    [("user", "hi"), ("assistant", "hello there")],
    [("system", "é́日本"), ("user", "x 😀 y"), ("assistant", "\n odd 😀\n"), ("user", "?"), ("assistant", "")],
    [("tool", "not shown"), ("assistant", "a"), ("tool", None)],
    [("user", "<|assistant|> as text </s>"), ("assistant", "it's <|user|> 1,234")],
    [("user", "only a question")],
    [("assistant", "word " * 300), ("user", "b"), ("assistant", " lead"), ("assistant", "two in a row")],
]


@pytest.mark.parametrize("which", range(3))
def test_masks_against_code_points(spark, chats, which):
    encoder = encoders()[which]
    rows = cw.sft_text(
        chats(*CHATS), eos=EOS, keep=["id"], masked=True, tokenizer=cw.OffsetTokenizer(encoder)
    ).rows.collect()
    assert len(rows) == len(CHATS)
    for r in rows:
        shown = CHATS[r.id]
        (expected,) = encoder.encode([r.text])
        assert r.tokens == list(expected[0]) and r.n_tokens == len(r.tokens)
        assert r["mask"] == plain_mask(r.text, shown, expected), shown


def test_tokens_that_straddle_a_border():
    starts, ends = np.array([0, 3, 6, 6, 9]), np.array([3, 6, 6, 9, 12])
    assert span_mask(starts, ends, [(4, 7)]).tolist() == [False, True, True, True, False]
    assert span_mask(starts, ends, [(4, 7)], straddling=False).tolist() == [False, False, True, False, False]
    assert span_mask(starts, ends, [(3, 9), (9, 9), (10, 11)]).tolist() == [False, True, True, True, True]
    assert span_mask(starts, ends, []).tolist() == [False] * 5
    assert span_mask(np.zeros(0, int), np.zeros(0, int), [(0, 4)]).tolist() == []


def test_random_spans_against_all_pairs():
    rng = random.Random(3)
    for _ in range(300):
        cuts = sorted(rng.sample(range(60), rng.randint(2, 12)))
        tokens = list(zip(cuts, cuts[1:]))
        borders = sorted(rng.sample(range(62), 2 * rng.randint(0, 4)))
        spans = list(zip(borders[::2], borders[1::2]))
        starts, ends = (np.array(x) for x in zip(*tokens))
        touching = [any(a < hi and b > lo for lo, hi in spans) for a, b in tokens]
        assert span_mask(starts, ends, spans).tolist() == touching
        inside = [any(a >= lo and b <= hi for lo, hi in spans) for a, b in tokens]
        assert span_mask(starts, ends, spans, straddling=False).tolist() == inside


def test_cut_and_packed_with_the_ids(spark, chats):
    tokenizer = cw.OffsetTokenizer(encoders()[0])
    text = cw.sft_text(chats(*CHATS), eos=EOS, keep=["id"], masked=True, tokenizer=tokenizer)
    whole = {r.id: (r.tokens, r["mask"]) for r in text.rows.collect()}
    short = cw.sft_text(chats(*CHATS), eos=EOS, keep=["id"], masked=True, max_length=5, tokenizer=tokenizer).rows
    for r in short.collect():
        assert (r.tokens, r["mask"]) == tuple(x[:5] for x in whole[r.id]) and r.n_tokens == len(whole[r.id][0])
    blocks = cw.packed_text(text, ["id"], block=64, shards=2, seed=1).collect()
    pairs = sorted(p for b in blocks for p in zip(b.tokens, b["mask"], strict=True))
    assert pairs == sorted(p for w in whole.values() for p in zip(*w))


def test_texts_are_encoded_once(chats):
    tokenizer = cw.OffsetTokenizer(encoders()[0])
    rows = cw.sft_text(chats(*CHATS), eos=EOS, masked=True, max_length=8, tokenizer=tokenizer).rows
    plan = plan_text(rows)
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


def test_nulls_and_decoding(spark):
    encoder = encoders()[0]
    df = spark.createDataFrame([("a </s> b",), (None,), ("",)], "t string")
    ids = df.withColumn("ids", cw.OffsetTokenizer(encoder)(F.col("t")))
    rows = ids.withColumn("back", cw.token_decoder(encoder.decode)(F.col("ids"))).collect()
    assert [r.back for r in rows] == ["a </s> b", None, ""] and rows[1].ids is None and rows[2].ids == []


def test_a_lister_has_no_masks(chats):
    with pytest.raises(ValueError, match="offsets"):
        cw.sft_text(chats(*CHATS), eos=EOS, masked=True, tokenizer=cw.token_lister(lambda t: [[1]] * len(t)))


def test_workers_hold_the_answers_of_one_bounded_call(spark):
    """64 long texts were one call, and all ids of an Arrow batch were decoded at once."""

    class Strict:
        """An encoder of characters that refuses calls of more text than a worker should hold answers of."""

        def encode(self, texts):
            assert len(texts) == 1 or sum(map(len, texts)) <= 1 << 18
            return [(list(map(ord, t)), list(range(len(t))), list(range(1, len(t) + 1))) for t in texts]

        def decode(self, ids):
            assert len(ids) == 1 or sum(map(len, ids)) <= 1 << 16
            return ["".join(map(chr, row)) for row in ids]

    rows = spark.range(0, 90, 1, 1).selectExpr("id", "if(id % 7 = 3, null, repeat(chr(65 + id % 20), 40 + 10000 * (id % 3))) AS text")
    tokenizer, decode = cw.OffsetTokenizer(Strict()), cw.token_decoder(Strict().decode)
    pieces = F.expr("array(struct(length(text) AS length, 10 AS start, 30 AS `end`))")
    found = rows.select("id", "text", tokenizer(F.col("text")).alias("ids"), tokenizer.masked(F.col("text"), pieces).alias("m"))
    for r in found.select("*", decode(F.col("ids")).alias("again")).collect():
        assert r.again == r.text
        if r.text is None:
            assert r.ids is None and r.m is None
        else:
            assert r.m.ids == r.ids == [ord(c) for c in r.text]
            assert r.m.mask == [10 <= i < 30 for i in range(len(r.text))]
