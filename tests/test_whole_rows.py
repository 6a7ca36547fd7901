"""Packing without cuts, against best fit row by row."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import convoweave as cw
from plan_checks import plan_text


def plain_best_fit(lengths, block):
    """Room left in each block after placing rows one by one, longest first, into the fullest block that takes them."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        at = min((i for i, room in enumerate(rooms) if room >= n), key=lambda i: rooms[i], default=None)
        if at is None:
            rooms.append(block)
            at = len(rooms) - 1
        rooms[at] -= n
    return sorted(rooms)


def check_plan(lengths, block):
    plan = cw.plan_slots(Counter(lengths), block)
    number = Counter()
    used = {}
    for n in lengths:
        (at,), (offset,) = plan.slots(np.array([n]), np.array([number[n]]))
        number[n] += 1
        used.setdefault(int(at), []).append((int(offset), n))
    assert set(used) == set(range(plan.blocks))
    for pieces in used.values():
        end = 0
        for offset, n in sorted(pieces):
            assert offset == end  # neither gaps nor overlaps
            end += n
        assert end <= block
    assert sorted(block - sum(n for _, n in p) for p in used.values()) == plain_best_fit(lengths, block)
    return plan


@settings(deadline=None, max_examples=200)
@given(st.integers(1, 40).flatmap(lambda b: st.tuples(st.just(b), st.lists(st.integers(1, b), max_size=60))))
def test_same_blocks_as_row_by_row(case):
    block, lengths = case
    check_plan(lengths, block)


def test_many_rows_of_few_lengths():
    rng = random.Random(5)
    check_plan([rng.choice([1, 7, 30, 33, 34, 50, 64, 99, 100]) for _ in range(1500)], 100)


def test_the_plan_does_not_grow_with_the_rows():
    rng = random.Random(1)
    counts = {n: rng.randint(1, 10**9) for n in range(1, 4097)}
    plan = cw.plan_slots(counts, 4096)
    assert len(plan.length) < 4096 * 12
    total = sum(n * c for n, c in counts.items())
    assert -(-total // 4096) <= plan.blocks <= 11 / 9 * (total / 4096) + 1
    many = {n: 10 * c for n, c in counts.items()}
    assert len(cw.plan_slots(many, 4096).length) < 4096 * 12


def test_lengths_outside_a_block_are_refused():
    for n in (0, 9):
        with pytest.raises(ValueError):
            cw.plan_slots({n: 1}, 8)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    lengths = [(i, rng.choice([0, 1, 5, 16, 17, 40, 7, 7, 7, 100])) for i in range(400)] + [(400, None)]
    # A third of the rows have one length.
    df = spark.createDataFrame(lengths, "id long, length int").repartition(5)
    return {k: n or 0 for k, n in lengths}, df.selectExpr("*", "transform(sequence(1, greatest(coalesce(length, 0), 1)), j -> concat(id, '.', j)) tokens")


@pytest.mark.parametrize("bits", [0, 3, 10])
def test_rows_find_their_slots(rows, bits):
    lengths, df = rows
    placed = cw.pack_whole(df, ["id"], "length", block=40, stretch_bits=bits).collect()
    pieces, used = {}, {}
    for r in placed:
        pieces.setdefault(r.id, []).append((r["from"], r.to))
        used.setdefault(r.block, []).append((r.offset, r.to - r["from"]))
    for key, n in lengths.items():
        cuts = list(range(0, n, 40)) + [n] if n else [0]
        assert sorted(pieces.get(key, [])) == list(zip(cuts, cuts[1:]))  # nothing up to a block is cut
    for held in used.values():
        ends = 0
        for offset, n in sorted(held):
            assert offset == ends
            ends += n
        assert ends <= 40
    sizes = [b - a for p in pieces.values() for a, b in p]
    assert sorted(40 - sum(n for _, n in h) for h in used.values()) == plain_best_fit(sizes, 40)


def test_slots_follow_from_key_and_seed(rows):
    _, df = rows
    one, two, other = (
        {(r.id, r["from"]): (r.block, r.offset) for r in cw.pack_whole(d, ["id"], "length", block=40, seed=s).collect()}
        for d, s in ((df, 1), (df.repartition(2), 1), (df, 2))
    )
    assert one == two != other


def test_blocks_and_their_lengths(rows):
    lengths, df = rows
    blocks = cw.whole_blocks(cw.pack_whole(df, ["id"], "length", block=40), "tokens").collect()
    found = Counter()
    for b in blocks:
        at = 0
        assert sum(b.lengths) == len(b.tokens) <= 40
        for n in b.lengths:
            found[tuple(b.tokens[at : at + n])] += 1
            at += n
    expected = Counter(
        tuple(f"{k}.{j + 1}" for j in range(a, min(a + 40, n))) for k, n in lengths.items() for a in range(0, n, 40)
    )
    assert found == expected


def test_no_rows_and_clashing_names(spark):
    df = spark.createDataFrame([], "id long, length int")
    assert cw.pack_whole(df, ["id"], "length", block=8).collect() == []
    with pytest.raises(ValueError, match="rename"):
        cw.pack_whole(df.withColumnRenamed("id", "block"), ["block"], "length", block=8)
    with pytest.raises(ValueError):
        cw.pack_whole(df, ["id"], "length", block=0)


def test_no_task_sees_a_whole_length(rows):
    _, df = rows
    assert "SinglePartition" not in plan_text(cw.pack_whole(df, ["id"], "length", block=40))
