import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from convoweave.llm import repeats
from llm_data import EDGES, prose, varied


def words_of(text):
    return text.encode().split() if text else []


def plain(rows, length):
    """(words, removed, kept) of each row, by comparing the words of all windows."""
    least = {}
    for k, text in rows:
        ws = words_of(text)
        for i in range(len(ws) - length + 1):
            w = tuple(ws[i : i + length])
            if k is not None:
                least[w] = min(least.get(w, k), k)
    out = []
    for k, text in rows:
        ws, gone = words_of(text), set()
        for i in range(len(ws) - length + 1):
            first = least.get(tuple(ws[i : i + length]))
            if first is not None and (k is None or first < k):
                gone.update(range(i, i + length))
        kept = [w for i, w in enumerate(ws) if i not in gone]
        out.append((k, len(ws), len(gone), None if text is None else b" ".join(kept).decode()))
    return sorted(out, key=repr)


def check(spark, rows, length=50, partitions=4):
    df = spark.createDataFrame([(k, t, "n", 1) for k, t in rows], "doc_id bigint, text string, _word string, n_words int").repartition(partitions)
    out = repeats.drop_repeats(df, length=length)
    assert out.columns == ["doc_id", "text", "_word", "n_words", "n_removed"]
    found = sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in out.collect()), key=repr)
    assert found == plain(rows, length)


def passages(seed, n, length):
    """Texts that share passages around ``length`` words, cut at all sides, in copies and alone."""
    rng = random.Random(seed)
    shared = [prose(1000 + seed * 10 + i, rng.randint(length - 3, 3 * length)).split() for i in range(6)]
    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(shared)
            a = rng.randint(0, 5)
            parts += rng.choice([p, p[a:], p[: len(p) - a], p[a : len(p) - rng.randint(0, 9)], prose(rng.random(), 20).split()])
        out.append(" ".join(parts))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_shared_passages(spark, seed):
    texts = passages(seed, 60, 50)
    check(spark, [(i * 3 % 61, t) for i, t in enumerate(texts)])


@pytest.mark.parametrize("length", [1, 7, 12])
def test_other_lengths(spark, length):
    check(spark, list(enumerate(passages(length, 25, length + 3))), length=length)


def test_copies_near_copies_ties_and_nulls(spark):
    base = prose(1, 400)
    rows = list(EDGES) + [(100 + i, base) for i in range(40)] + [(7, base), (7, base + " more")] + [(None, base), (None, prose(77, 90)), (None, prose(77, 90))]
    rows += [(200 + i, varied(base, i, 0.01)) for i in range(20)] + [(300, "same " * 500), (301, "same " * 120), (302, "same " * 49)]
    check(spark, rows)


def test_a_window_inside_one_document_is_no_repeat(spark):
    p = prose(4, 60)
    check(spark, [(1, f"{p} x {p}"), (2, prose(5, 100))])


def test_empty_table(spark, no_rows):
    out = repeats.drop_repeats(no_rows)
    assert out.collect() == []


def test_stretches_are_maximal(spark):
    p = prose(9, 130)
    df = spark.createDataFrame([(1, p), (2, f"a b {p} c {p}")], "doc_id bigint, text string")
    (row,) = repeats.repeated_stretches(df).collect()
    n = len(p.split())
    assert row._id == 2 and [tuple(s) for s in row.stretches] == [(2, 2 + n), (3 + n, 3 + 2 * n)]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=80), st.integers(1, 20))
def test_minima_are_leftmost(values, width):
    v = np.array(values)
    found = repeats.leftmost_minima(v, width)
    assert found.tolist() == [i + int(np.argmin(v[i : i + width])) for i in range(len(v) - width + 1)]


@given(st.lists(st.integers(0, 2**64 - 1), max_size=40), st.integers(1, 20))
def test_run_hashes(values, n):
    with np.errstate(over="ignore"):
        found = repeats.run_hashes(np.array(values, np.uint64), np.uint64(1000003), n).tolist()
    assert len(found) == max(len(values) - n + 1, 0)
    for i, h in enumerate(found):
        expected = 0
        for v in values[i : i + n]:
            expected = (expected * 1000003 + v) % 2**64
        assert h == expected
