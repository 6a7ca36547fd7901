"""The permutation against plain integers."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

import convoweave as cw
from convoweave.functions.permutation import round_keys
from plan_checks import plan_text

P = 2**31 - 1


def plain_place(x, n, seed):
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    while True:
        left, right = divmod(x, b)
        for r in range(6):
            k = int(hashlib.md5(f"{seed}:permute:{r}".encode()).hexdigest()[:7], 16)
            digit = right if r % 2 == 0 else left
            y = (digit + k) % P
            z = (y * y + k) % P
            if r % 2 == 0:
                left = (left + z * z % P) % a
            else:
                right = (right + z * z % P) % b
        x = left * b + right
        if x < n:
            return x


@pytest.mark.parametrize("n,seed", [(1, 0), (2, 1), (3, 5), (10, 3), (97, 0), (1000, 42), (1024, 42), (4999, 7)])
def test_every_place_once_and_back(spark, n, seed):
    order = cw.Permutation(n, seed)
    rows = spark.range(n).withColumn("p", order.place(F.col("id"))).withColumn("back", order.item(F.col("p"))).collect()
    assert sorted(r.p for r in rows) == list(range(n))
    assert all(r.back == r.id and r.p == plain_place(r.id, n, seed) for r in rows)


@pytest.mark.parametrize("n", [10**9 + 7, 10**12, (1 << 60) + 12345])
def test_large_numbers(spark, n):
    order = cw.Permutation(n, 3)
    items = [0, 1, 2, n // 3, n // 2, n - 2, n - 1]
    df = spark.createDataFrame([(i,) for i in items], "id bigint").withColumn("p", order.place(F.col("id")))
    for r in df.withColumn("back", order.item(F.col("p"))).collect():
        assert 0 <= r.p < n and r.back == r.id and r.p == plain_place(r.id, n, 3)


def test_seeds_differ_and_neighbours_part(spark):
    n = 2000
    one, two = ([r.p for r in spark.range(n).select(cw.Permutation(n, s).place(F.col("id")).alias("p")).collect()] for s in (1, 2))
    assert sum(x == y for x, y in zip(one, two)) < 10 and round_keys(1) != round_keys(2)
    steps = [abs(x - y) for x, y in zip(one, one[1:])]
    assert n / 4 < sum(steps) / len(steps) < n / 2.5  # a third for a random order


def test_outside_numbers_are_null(spark):
    order = cw.Permutation(5, 1)
    df = spark.createDataFrame([(None,), (-1,), (5,), (4,)], "id bigint")
    assert [r[0] is None for r in df.select(order.place(F.col("id"))).collect()] == [True, True, True, False]
    assert spark.range(1).select(cw.Permutation(0).place(F.col("id"))).collect()[0][0] is None
    with pytest.raises(ValueError):
        cw.Permutation(-1)


@pytest.fixture(scope="module")
def docs(spark):
    keys = [(i * 37 % 501, f"v{i}") for i in range(501)]
    return spark.createDataFrame(keys, "k int, v string").repartition(6)


def test_dense_numbers(docs):
    numbered, n = cw.number_rows(docs, ["k"])
    assert n == 501 and all(r._number == r.k for r in numbered.collect())
    as_read, n = cw.number_rows(docs)
    assert sorted(r._number for r in as_read.collect()) == list(range(501)) and "rangepartitioning" not in plan_text(as_read)
    empty, n = cw.number_rows(docs.where("false"), ["k"])
    assert n == 0 and empty.collect() == []


def test_shuffles_and_samples(docs):
    placed = {r.k: r.place for r in cw.shuffle_rows(docs, ["k"], seed=9).collect()}
    assert placed == {k: plain_place(k, 501, 9) for k in range(501)}
    again = {r.k: r.place for r in cw.shuffle_rows(docs.repartition(2), ["k"], seed=9).collect()}
    assert again == placed
    small, large = ({r.k for r in cw.sample_rows(docs, ["k"], fraction=f, seed=9).collect()} for f in (0.1, 0.5))
    assert small < large and (len(small), len(large)) == (50, 250)
    assert small == {k for k, p in placed.items() if p < 50}
    with pytest.raises(ValueError):
        cw.sample_rows(docs, fraction=1.5, seed=0)


def test_nothing_is_sorted_by_place(docs):
    plan = plan_text(cw.shuffle_rows(docs, ["k"], seed=9).where("place between 10 and 20"))
    assert "Sort" not in plan and "Exchange hashpartitioning" not in plan
