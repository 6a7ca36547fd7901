"""Counts that come with the write, in one job and with the files' own numbers."""

import uuid

import pytest
from pyspark.sql import functions as F

import convoweave as cw
from convoweave.sources.sinks import _in_order


def jobs(spark, action):
    """What an action returns, and how many jobs it ran."""
    group, context = uuid.uuid4().hex, spark.sparkContext
    context.setJobGroup(group, "count")
    try:
        return action(), len(context.statusTracker().getJobIdsForGroup(group))
    finally:
        context._jsc.clearJobGroup()


@pytest.fixture
def splits(spark):
    rows = spark.range(1000).withColumn("order", F.md5(F.col("id").cast("string"))).repartition(5)
    return {"train": rows.where("id % 10 <> 0"), "test": rows.where("id % 10 = 0"), "odd name": rows.where("false")}


def by_split(spark, path):
    return {r.split: r["count"] for r in spark.read.parquet(path).groupBy("split").count().collect()}


@pytest.mark.parametrize("order", [None, "order"])
def test_counts_are_those_of_the_files(spark, splits, tmp_path, order):
    path = str(tmp_path / "out")
    counts = cw.write_splits(splits, path, order_key=order, files=4)
    assert counts == {"train": 900, "test": 100, "odd name": 0}
    assert by_split(spark, path) == {"train": 900, "test": 100}


def test_no_job_is_added_for_counting(spark, tmp_path):
    rows = spark.range(0, 900, 1, 5).withColumn("order", F.md5(F.col("id").cast("string")))
    marked = rows.withColumn("split", F.lit("train"))
    _, without = jobs(
        spark, lambda: _in_order(marked, ["train"], "order", 3).write.partitionBy("split").parquet(str(tmp_path / "plain"))
    )
    counts, with_counts = jobs(
        spark, lambda: cw.write_splits({"train": rows}, str(tmp_path / "counted"), order_key="order", files=3)
    )
    assert counts == {"train": 900} and with_counts == without


def test_rows_of_a_task_that_is_tried_again_count_once(spark, tmp_path):
    """A second attempt of a writing task, forced by an error of the first."""
    marks = str(tmp_path / "marks")

    def once(batches):
        import os

        from pyspark import TaskContext

        for batch in batches:
            yield batch
        if TaskContext.get().partitionId() == 1 and not os.path.exists(marks):
            open(marks, "w").close()
            raise RuntimeError("lost")

    rows = spark.range(400).withColumn("split", F.lit("train")).repartition(4)
    broken = rows.mapInArrow(once, rows.schema)
    path = str(tmp_path / "out")
    try:
        counts = cw.write_splits({"train": broken.drop("split")}, path)
    except Exception:  # local sessions try a task once only: the job is run again as a whole
        counts = cw.write_splits({"train": broken.drop("split")}, path, mode="overwrite")
    assert counts == {"train": 400} and by_split(spark, path) == counts


def test_an_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "id long")
    assert cw.write_splits({"train": empty}, str(tmp_path / "out")) == {"train": 0}


def test_metrics_of_a_mixture(spark, tmp_path):
    spark.range(200).withColumn("text", F.lit("t")).write.parquet(str(tmp_path / "docs"))
    spec = {"datasets": [{"id": "docs", "key": ["id"], "columns": ["id", "text"], "weight": 0.5}], "seed": 3, "test_split_size": 0.1}
    plan = cw.plan_mixture(spark, cw.Mixture.from_dict(spec), str(tmp_path))
    rows = plan.write(str(tmp_path / "out"), metrics=str(tmp_path / "metrics"))
    assert rows == {"train": 90, "test": 10} == by_split(spark, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "metrics")).first().asDict() == {"train_samples": 90, "eval_samples": 10}
