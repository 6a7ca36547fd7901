"""Bucketed run tables: the same rows, without an exchange."""

import pytest

import convoweave as cw
from convoweave.operators import catalogue
from plan_checks import plan_text


@pytest.fixture(scope="module")
def tables(spark):
    runs = spark.createDataFrame([(f"results/sft/r{i % 300}", i % 7 == 0, i) for i in range(300)], "path string, finished boolean, step long")
    configs = spark.createDataFrame(
        [(f"results/sft/r{i}", f"org/r{i}") for i in range(0, 400, 2)] + [("results/sft/r4", "org/a"), (None, "org/none")],
        "run string, hub_model_id string",
    )
    listing = spark.createDataFrame([(f"results/sft/r{i}/train_results.json", False) for i in range(0, 300, 3)], "path string, is_dir boolean")
    return runs, configs, listing


@pytest.fixture(autouse=True)
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_joins_by_path_need_no_exchange(tables):
    runs, configs, _ = tables
    kept = catalogue.attach_hub_ids(cw.keep_by_path(runs, buckets=5), cw.keep_by_path(configs, column="run", buckets=5))
    plain = catalogue.attach_hub_ids(runs, configs)
    assert "Exchange" in plan_text(plain) and "Exchange" not in plan_text(kept)
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, plain.collect()))


def test_only_the_other_side_is_shuffled(tables):
    runs, _, listing = tables
    kept = catalogue.finished_runs(cw.keep_by_path(runs, buckets=4), listing)
    assert plan_text(kept).count("Exchange") == 1
    assert {r.path for r in kept.collect()} == {r.path for r in catalogue.finished_runs(runs, listing).collect()}


def test_a_table_is_replaced(spark, tables, tmp_path):
    runs, _, _ = tables
    for n in (10, 20):
        kept = cw.keep_by_path(runs.limit(n), buckets=2, name="kept_runs", location=str(tmp_path / "runs"))
        assert kept.count() == n
    with pytest.raises(ValueError):
        cw.keep_by_path(runs, buckets=0)
