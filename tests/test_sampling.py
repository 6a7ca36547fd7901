"""Exact cuts: size, determinism, nesting, and agreement with a sort."""

import hashlib
import math
from collections import Counter
from hashlib import md5

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import convoweave as cw
from convoweave.functions.keys import row_key
from convoweave.operators import exact_cut
from convoweave.operators.exact_cut import DuplicateKeys


def plain_order(n, stage, member="", seed=0):
    digest = lambda i: hashlib.md5(f"{seed}:{stage}:{member}:{i}".encode()).hexdigest()
    return sorted(range(n), key=lambda i: (digest(i), str(i)))


def ids(df):
    return {row.id for row in df.select("id").collect()}


@pytest.mark.parametrize("n,w", [(100, 0.29), (1, 0.5), (7, 0.999), (1000, 0.001), (11, 0.1)])
def test_size_is_int_of_double_product(spark, n, w):
    kept = cw.exact_sample(spark.range(n), ["id"], fraction=w)
    assert ids(kept) == set(plain_order(n, "sample")[: int(n * w)])
    assert kept.count() == int(n * w)


def test_decimal_trap_gives_28(spark):
    assert cw.exact_sample(spark.range(100), ["id"], fraction=0.29).count() == 28


@pytest.mark.parametrize("fetch_rows", [1, 2, 17, 20_000])
@pytest.mark.parametrize("k", [1, 2, 500, 2499, 4998, 4999])
def test_narrowing_finds_the_same_rows_as_a_sort(spark, fetch_rows, k):
    kept = cw.exact_sample(spark.range(5000), ["id"], k=k, fetch_rows=fetch_rows)
    assert ids(kept) == set(plain_order(5000, "sample")[:k])


def test_narrowing_survives_wrong_guesses(spark, monkeypatch):
    """With a window of no width the guess misses; the other sides must lead on."""
    monkeypatch.setattr(exact_cut, "_SIGMAS", 0.0)
    for k in (3, 1000, 1990):
        kept = cw.exact_sample(spark.range(2000), ["id"], k=k, fetch_rows=5)
        assert ids(kept) == set(plain_order(2000, "sample")[:k])


def test_nested_by_weight_and_independent_of_partitioning(spark):
    base = spark.range(3000)
    small = ids(cw.exact_sample(base, ["id"], fraction=0.2, seed=9))
    large = ids(cw.exact_sample(base, ["id"], fraction=0.7, seed=9))
    assert small < large
    for parts in (1, 3, 17):
        assert ids(cw.exact_sample(base.repartition(parts), ["id"], fraction=0.2, seed=9)) == small
    assert ids(cw.exact_sample(base, ["id"], fraction=0.2, seed=10)) != small


@pytest.mark.parametrize("fraction", [0, 1.5, -1, True, "0.5"])
def test_bad_fractions(spark, fraction):
    with pytest.raises(ValueError):
        cw.exact_sample(spark.range(10), ["id"], fraction=fraction)


def test_edges_of_k(spark):
    assert cw.exact_sample(spark.range(10), ["id"], k=0).count() == 0
    assert cw.exact_sample(spark.range(10), ["id"], k=10).count() == 10
    assert cw.exact_sample(spark.range(10), ["id"], fraction=1.0).count() == 10
    with pytest.raises(ValueError):
        cw.exact_sample(spark.range(10), ["id"], k=11)
    with pytest.raises(ValueError):
        cw.exact_sample(spark.range(10), ["id"])


@pytest.mark.parametrize("fetch_rows", [2, 1000])
def test_duplicate_keys_are_reported_not_kept_together(spark, fetch_rows):
    twins = spark.range(500).withColumn("id", F.lit(7))
    with pytest.raises(DuplicateKeys):
        cw.exact_sample(twins, ["id"], k=100, fetch_rows=fetch_rows)


@pytest.mark.parametrize("fetch_rows", [2, 1000])
def test_rows_that_share_a_key_are_cut_by_content(spark, fetch_rows):
    """Such keys raised an error wherever the cut fell between their rows."""
    shared = spark.range(500).selectExpr("id div 5 % 40 AS key", "id % 5 % 3 AS value")
    key = lambda r: (md5(f"0:sample::{r[0]}".encode()).hexdigest(), str(r[0]))
    rows = sorted((tuple(r) for r in shared.collect()), key=key)
    before = Counter()
    for k in (1, 7, 123, 124, 125, 126, 250, 499):
        kept = Counter(map(tuple, cw.exact_sample(shared, ["key"], k=k, fetch_rows=fetch_rows, by_content=True).collect()))
        assert kept.total() == k and kept <= Counter(rows)
        assert sorted(a for a, _ in kept.elements()) == sorted(a for a, _ in rows[:k])
        assert before <= kept  # nested
        before = kept
    twins = spark.range(500).withColumn("id", F.lit(7))
    assert cw.exact_sample(twins, ["id"], k=100, fetch_rows=fetch_rows, by_content=True).count() == 100


def test_null_keys_are_rows_too(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 'a'), (2, NULL), (3, 'b') AS t(id, k)")
    parts = cw.train_test_split(df, ["k"], test_size=0.3)
    assert ids(parts["train"]) | ids(parts["test"]) == {1, 2, 3}


@pytest.mark.parametrize("n,size", [(11, 0.1), (100, 0.07), (2, 0.5), (1000, 0.333)])
def test_split_is_exact_disjoint_complete(spark, n, size):
    parts = cw.train_test_split(spark.range(n), ["id"], test_size=size, seed=3)
    train, test = ids(parts["train"]), ids(parts["test"])
    assert len(test) == math.ceil(n * size)
    assert not train & test and train | test == set(range(n))
    assert test == set(plain_order(n, "split", seed=3)[: len(test)])


@pytest.mark.parametrize("size", [0, 1, 1.5, -0.1])
def test_bad_split_sizes(spark, size):
    with pytest.raises(ValueError):
        cw.train_test_split(spark.range(10), ["id"], test_size=size)


def test_split_with_an_empty_side(spark):
    with pytest.raises(ValueError):
        cw.train_test_split(spark.range(1), ["id"], test_size=0.5)


def test_stage_salts_keep_sampling_out_of_the_split(spark):
    kept = cw.exact_sample(spark.range(20_000), ["id"], fraction=0.1, seed=1)
    parts = cw.train_test_split(kept, ["id"], test_size=0.1, seed=1)
    lowest = set(plain_order(20_000, "sample", seed=1)[:200])
    assert len(ids(parts["test"]) & lowest) < 60


@pytest.mark.parametrize("copies_per_row", [1, 3, 100_000])
def test_content_keys_number_the_copies(spark, copies_per_row):
    rows = [("a", 1)] * 50 + [("b", 1)] * 3 + [("a", 2), (None, 1), (None, 1)]
    df = spark.createDataFrame(rows, "text string, n int")
    keyed = cw.with_content_key(df, "key", copies_per_row=copies_per_row)
    out = keyed.collect()
    assert sorted(((r.text or "", r.n) for r in out)) == sorted((t or "", n) for t, n in rows)
    assert len({r.key for r in out}) == len(rows)


def test_content_keys_take_names_literally(spark):
    df = spark.sql("SELECT 1 AS `a.b`, array('x') AS `c d` UNION ALL SELECT 1, array('x')")
    assert {len(r) for r in cw.with_content_key(df, "key").collect()} == {3}


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(2, 400), st.floats(0.001, 0.999), st.integers(0, 9), st.sampled_from([3, 20_000]))
def test_any_size_any_weight(spark, n, weight, seed, fetch_rows):
    kept = cw.exact_sample(spark.range(n), ["id"], fraction=weight, seed=seed, fetch_rows=fetch_rows)
    assert ids(kept) == set(plain_order(n, "sample", seed=seed)[: int(n * weight)])


def test_keyless_sample_splits_copies(spark):
    df = spark.createDataFrame([("same",)] * 40, "text string")
    keyed = cw.with_content_key(df, "key")
    assert cw.exact_sample(keyed, ["key"], fraction=0.25).count() == 10


def test_content_key_with_conversations(chats):
    keyed = cw.with_content_key(
        chats([("user", "a")], [("user", "a")], None).drop("id"), "key"
    )
    assert keyed.select("key").distinct().count() == 3


def test_streams_are_refused(spark):
    stream = spark.readStream.format("rate").load().withColumnRenamed("value", "id")
    with pytest.raises(ValueError):
        cw.exact_sample(stream, ["id"], fraction=0.5)


def test_keys_tell_all_rows_apart(spark):
    rows = [("a\x1fb", "c"), ("a", "b\x1fc"), (None, "x"), ("\\N", "x"), ("\\", "\\s"), ("\\\\", "s"), ("a\\sb", "c")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert cw.with_content_key(df, "key").select("key").distinct().count() == len(rows)
    assert df.select(row_key(["a", "b"]).alias("k")).distinct().count() == len(rows)
    times = spark.sql(
        "SELECT explode(array(struct(timestamp'2020-01-01 00:00:00.000001' AS t), "
        "struct(timestamp'2020-01-01 00:00:00.000002' AS t), struct(cast(null AS timestamp) AS t))) AS s"
    )
    assert cw.with_content_key(times, "key").select("key").distinct().count() == 3
    assert cw.with_content_key(times.select("s.t"), "key").select("key").distinct().count() == 3


def test_key_columns_are_taken_literally(spark):
    df = spark.createDataFrame([(i,) for i in range(40)], "`a.b` bigint")
    assert cw.exact_sample(df, ["a.b"], fraction=0.5, seed=1, member="m").count() == 20
