"""Weighted samples against sorting all keys."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

import convoweave as cw
from convoweave.operators import weighted_sample as ws
from plan_checks import plan_text


def plain(rows, k, seed):
    keyed = []
    for key, w in rows:
        if w is None or math.isnan(w) or w == 0:
            continue
        digest = hashlib.md5(f"{seed}:weigh::{key}".encode()).hexdigest()
        u = ((int(digest[:15], 16) >> 8) + 1) / 2**52
        keyed.append((-math.log(u) / w, digest, key))
    return {key for *_, key in sorted(keyed)[:k]}


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, w double").repartition(4)


@pytest.mark.parametrize("k", [0, 1, 7, 150, 399, 1000])
def test_exactly_the_smallest_keys(spark, k):
    rows = [(i, [0.5, 1.0, 20.0, None, 0.0, float("nan"), 3.3][i % 7]) for i in range(400)]
    found = {r.id for r in cw.weighted_sample(frame(spark, rows), ["id"], "w", k=k, seed=5).collect()}
    assert found == plain(rows, k, 5)


def test_sketches_only_narrow_the_passes(spark, monkeypatch):
    monkeypatch.setattr(ws, "_FETCH", 50)
    rows = [(i, 1.0 + i % 5) for i in range(30_000)]
    for k in (3, 12_345, 29_990):
        found = {r.id for r in cw.weighted_sample(frame(spark, rows), ["id"], "w", k=k, seed=2).collect()}
        assert found == plain(rows, k, 2)


def test_keys_that_are_all_equal(spark, monkeypatch):
    monkeypatch.setattr(ws, "_FETCH", 20)
    rows = [(i, 1.7e308) for i in range(300)] + [(i, 1e-9) for i in range(300, 310)]
    assert cw.weighted_sample(frame(spark, rows), ["id"], "w", k=120).count() == 120
    doubled = frame(spark, [(1, 2.0)] * 60)
    with pytest.raises(ValueError, match="identify"):
        cw.weighted_sample(doubled, ["id"], "w", k=30)
    monkeypatch.setattr(ws, "_FETCH", 1000)
    with pytest.raises(ValueError, match="identify"):
        cw.weighted_sample(doubled, ["id"], "w", k=30)


def test_samples_are_nested_and_follow_the_weights(spark):
    rows = [(i, 4.0 if i % 2 else 1.0) for i in range(4000)]
    df = frame(spark, rows)
    small, large = ({r.id for r in cw.weighted_sample(df, ["id"], "w", fraction=f, seed=1).collect()} for f in (0.1, 0.4))
    assert small < large and (len(small), len(large)) == (400, 1600)
    heavy = sum(i % 2 for i in small)
    assert 290 < heavy < 340  # four fifths of the first draws, a little less later on
    assert small != {r.id for r in cw.weighted_sample(df, ["id"], "w", fraction=0.1, seed=9).collect()}


def test_the_sample_is_a_filter(spark):
    df = spark.range(100).withColumn("w", F.lit(1.0))
    assert "Exchange" not in plan_text(cw.weighted_sample(df, ["id"], F.col("w") + 1, k=5))


def test_wrong_arguments(spark):
    df = frame(spark, [(1, -1.0)])
    with pytest.raises(Exception, match="weight"):
        cw.weighted_sample(df, ["id"], "w", k=1).collect()
    for bad in ({}, {"k": 1, "fraction": 0.5}, {"k": -1}, {"fraction": 1.5}):
        with pytest.raises(ValueError):
            cw.weighted_sample(df, ["id"], "w", **bad)
    assert cw.weighted_sample(frame(spark, [(1, 0.0)]), ["id"], "w", k=3).collect() == []
