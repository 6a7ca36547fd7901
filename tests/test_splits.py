import pytest

from convoweave.sources.tables import MAX_SPLITS, load_dataset


def test_rows_without_a_split_are_a_split(spark, tmp_path):
    rows = [(1, "b"), (2, None), (3, "a"), (4, None)]
    spark.createDataFrame(rows, "id int, split string").write.parquet(str(tmp_path / "some"))
    spark.createDataFrame([(5, None)], "id int, split string").write.parquet(str(tmp_path / "none"))
    found = load_dataset(spark, "some", root=str(tmp_path))
    assert list(found) == ["a", "b", None]
    assert {k: sorted(r.id for r in v.collect()) for k, v in found.items()} == {"a": [3], "b": [1], None: [2, 4]}
    assert {k: v.count() for k, v in load_dataset(spark, "none", root=str(tmp_path)).items()} == {None: 1}


def test_too_many_values_are_refused(spark, tmp_path):
    spark.range(MAX_SPLITS + 1).selectExpr("id", "cast(id as string) split").write.parquet(str(tmp_path / "ids"))
    with pytest.raises(ValueError, match="names no splits"):
        load_dataset(spark, "ids", root=str(tmp_path))
