"""Arrow column functions: rows as with batches, and plans that see through them."""

import os

import pyarrow.compute as pc
import pytest

import convoweave as cw
from plan_checks import plan_text


@pytest.fixture
def docs(spark, tmp_path):
    rows = [(i, f"t{i}" if i % 4 else None, i % 3, 1.5 * i) for i in range(60)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "id long, text string, k int, unused double").write.parquet(path)
    return spark.read.parquet(path)


UPPER = cw.ArrowColumn(lambda t: pc.utf8_upper(t), "string", ["text"])
NEXT = cw.ArrowColumn(lambda k, i: pc.add(k.cast("int64"), i), "bigint", ["k", "id"])


def test_same_rows_as_batches(docs):
    columns = cw.apply_transform(docs, cw.ColumnTransform({"text": UPPER, "sum": NEXT}))
    batches = cw.apply_transform(
        docs, cw.BatchTransform(lambda b: b.assign(text=b["text"].str.upper(), sum=b["k"] + b["id"]), "text string, sum bigint")
    )
    assert columns.columns == batches.columns
    assert sorted(map(tuple, columns.collect())) == sorted(map(tuple, batches.collect()))


def test_filters_and_projections_reach_the_scan(docs):
    out = cw.apply_transform(docs, cw.ColumnTransform({"text": UPPER, "sum": NEXT}))
    plan = plan_text(out.where("k = 1 and id > 5").select("id", "sum"))
    assert "EqualTo(k,1)" in plan and "GreaterThan(id,5)" in plan
    assert "ReadSchema: struct<id:bigint,k:int>" in plan and plan.count("ArrowEvalPython") == 1
    assert "Python" not in plan_text(out.select("id"))  # what nobody asks for is not computed


def test_members_take_them(spark, docs, tmp_path):
    spec = cw.Member("docs", key=["id"], columns=["id", "text", "k"], transform=cw.ColumnTransform({"text": UPPER}), weight=None)
    mixture = cw.Mixture([spec], seed=1)
    frame = cw.plan_mixture(spark, mixture, str(tmp_path)).frame
    assert {r.id: r.text for r in frame.collect()} == {i: f"T{i}" if i % 4 else None for i in range(60)}


def test_wrong_columns(docs):
    with pytest.raises(ValueError, match="made of"):
        cw.apply_transform(docs, cw.ColumnTransform({"x": cw.ArrowColumn(pc.utf8_upper, "string", ["nope"])}))
    with pytest.raises(ValueError):
        cw.apply_transform(docs, cw.ColumnTransform({}))
    short = cw.apply_transform(docs, cw.ColumnTransform({"x": cw.ArrowColumn(lambda t: t.slice(1), "string", ["text"])}))
    with pytest.raises(Exception, match="length"):
        short.collect()


def test_one_split_is_replaced(spark, docs, tmp_path):
    path = str(tmp_path / "splits")
    cw.write_splits({"train": docs.where("k > 0"), "test": docs.where("k = 0")}, path)
    files = {f: os.stat(f"{path}/split=train/{f}").st_mtime_ns for f in os.listdir(f"{path}/split=train")}
    assert cw.write_splits({"test": docs.where("id < 7")}, path, mode="overwrite_splits") == {"test": 7}
    assert files == {f: os.stat(f"{path}/split=train/{f}").st_mtime_ns for f in os.listdir(f"{path}/split=train")}
    counts = {r.split: r["count"] for r in spark.read.parquet(path).groupBy("split").count().collect()}
    assert counts == {"train": 40, "test": 7}
    cw.write_splits({"new": docs.where("id < 3")}, path, mode="overwrite_splits")
    assert spark.read.parquet(path).count() == 50
