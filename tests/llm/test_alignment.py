import hashlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from convoweave.llm import alignment
from llm_data import EDGES, prose

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

ODD = [
    "tab\tand\r\nline  end \n\n  x ", " leading", "trailing  ", "a,b. c,d.e word, word. Wort, ὀδός. ² ²", "no\x1cbreak\x85here x　y",
    "▁ is a space there", "<s> </s> <unk> <0x41> <|endoftext|>", "it's they'll we'd I'm", "1,234.50 $5 100%", "\n", " ", ".", "ﬁne Å é",
    "x" * 3000, "word " * 2000, "if (a) {\r\n  b();\r\n}", "a­b​c ﻿", "12 ٣٤ Ⅷ ½", "\t\tx", "مرحبا بالعالم 你好,世界. ", "a\xa0 b  c", "� kept",
]


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def plain_tokens(sides, text):
    """Both sides as (id, bytes), byte-level entries decoded one by one."""
    a, b = sides
    alphabet = alignment._byte_alphabet()
    if not text:
        return [], []
    left = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        byte = len(piece) == 6 and piece.startswith("<0x")
        right.append((i, bytes.fromhex(piece[3:5]) if byte else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    same = b"".join(x for _, x in left) == whole == b"".join(x for _, x in right)
    return (left, right) if same else ([], [])


def spans(tokens):
    at, out = 0, []
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def plain(sides, rows):
    links, groups = {}, {}
    for k, text in rows:
        left, right = map(spans, plain_tokens(sides, text))
        links[k], j = [], 0
        for i, s, e in left:
            while j and right[j][1] > s:
                j -= 1
            while j < len(right) and right[j][2] <= s:
                j += 1
            while j < len(right) and right[j][1] < e:
                links[k].append((i, right[j][0]))
                j += 1
            j = max(j - 1, 0)
        ends = sorted({e for *_, e in left} & {e for *_, e in right})
        parts = []
        for lo, hi in zip([0, *ends], ends):
            parts.append("|".join(",".join(str(i) for i, s, e in side if lo <= s and e <= hi) for side in (left, right)) if len(left) < 5000 else None)
        groups[k] = (len(left), len(right), len(ends), parts)
    counts = Counter(x for found in links.values() for x in found)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = {}
    for k, _ in rows:
        n_a, n_b, n_groups, parts = groups[k]
        text = ";".join(parts) if None not in parts else None
        out[k] = (
            n_a, n_b, n_groups, len(links[k]), sum(counts[x] == most[x[1]] for x in links[k]), sum(counts[x] for x in links[k]),
            "" if not n_a else text and hashlib.sha256(text.encode()).hexdigest(),
        )
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def check(spark, sides, texts, partitions=3):
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "k bigint, text string").withColumns({"n_links": F.lit("x"), "_c0": F.lit(1)}).repartition(partitions)
    out = alignment.align_corpus(df, A, B)
    assert out.columns == ["k", "_c0", *COLUMNS]
    found = {r.k: tuple(r[c] for c in COLUMNS) for r in out.collect()}
    expected = plain(sides, rows)
    assert found.keys() == expected.keys()
    for k in expected:
        want = expected[k]
        assert found[k][:6] == want[:6] and want[6] in (None, found[k][6]), (texts[k], found[k], want)


def test_odd_texts(spark, sides):
    check(spark, sides, [t for _, t in EDGES if t is None or len(t) < 20_000] + ODD + [prose(i, 60) for i in range(20)])


def test_tokens_of_chunks_are_those_of_whole_texts(sides):
    pair = alignment.token_pair(A, B)
    texts = [t for _, t in EDGES] + ODD + [prose(5, 4000).replace("a", "ä")]
    (ids_a, n_a), (ids_b, n_b) = pair.encode([None if t is None else t.encode() for t in texts])
    at = [0, 0]
    for k, t in enumerate(texts):
        left, right = plain_tokens(sides, t)
        assert ids_a[at[0] : at[0] + n_a[k]].tolist() == [i for i, _ in left]
        assert ids_b[at[1] : at[1] + n_b[k]].tolist() == [i for i, _ in right]
        at = [at[0] + n_a[k], at[1] + n_b[k]]


def test_counts_go_over_all_blocks(spark, sides):
    texts = [prose(i % 7, 40) for i in range(60)] + [None, ""]
    check(spark, sides, texts, partitions=9)


def test_no_rows_and_no_tokens(spark, sides, no_rows):
    out = alignment.align_corpus(no_rows, A, B, keep=["doc_id"])
    assert out.columns == ["doc_id", *COLUMNS] and out.collect() == []
    check(spark, sides, [None, "", None])


def test_invalid_utf8_has_no_tokens():
    pair = alignment.token_pair(A, B)
    (ids_a, n_a), (ids_b, n_b) = pair.encode([b"a \xff b", b"ok"])
    assert n_a[0] == n_b[0] == 0 and n_a[1] > 0
