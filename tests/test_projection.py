"""Strict columns, union, and the two forms of transform."""

import pytest
from pyspark.sql import functions as F

import convoweave as cw


@pytest.fixture(scope="module")
def ab(spark):
    return spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")


def test_select_unknown_column(ab):
    with pytest.raises(ValueError):
        cw.select_columns(ab, ["a", "nope"])
    assert cw.select_columns(ab, ["b"]).columns == ["b"]


def test_rename_in_order(ab):
    assert cw.rename_sequential(ab, {"b": "c", "a": "b"}).columns == ["b", "c"]
    assert cw.rename_sequential(ab, {"a": "t", "t": "u"}).columns == ["u", "b"]


@pytest.mark.parametrize("renames", [{"nope": "c"}, {"a": "b"}, {"a": "b", "b": "c"}])
def test_rename_missing_source_or_taken_target(ab, renames):
    with pytest.raises(ValueError):
        cw.rename_sequential(ab, renames)


def test_union_fills_nulls_keeps_duplicates(spark, ab):
    both = cw.concat_members([ab, ab, spark.createDataFrame([("z",)], "b string")])
    assert sorted((r.a or 0, r.b) for r in both.collect()) == [
        (0, "z"), (1, "x"), (1, "x"), (2, "y"), (2, "y"),
    ]


def test_union_rejects_clashing_types(spark, ab):
    with pytest.raises(TypeError):
        cw.concat_members([ab, spark.createDataFrame([("1",)], "a string")])
    with pytest.raises(ValueError):
        cw.concat_members([])


def test_union_aligns_struct_fields_and_accepts_untyped_null(spark):
    one = spark.sql("SELECT array(struct('u' AS role, 'c' AS content)) AS m, 1 AS n")
    two = spark.sql("SELECT array(struct('d' AS content, 'v' AS role)) AS m, NULL AS n")
    rows = cw.concat_members([one, two]).collect()
    assert {(r.m[0].role, r.m[0].content) for r in rows} == {("u", "c"), ("v", "d")}
    other = spark.sql("SELECT array(struct('d' AS content, 'v' AS who)) AS m, 2 AS n")
    with pytest.raises(TypeError):
        cw.concat_members([one, other])


def test_empty_conversations_go(chats, ab):
    kept = cw.drop_empty_conversations(chats(None, [], [("user", "a")]))
    assert [r.id for r in kept.collect()] == [2]
    assert cw.drop_empty_conversations(ab) is ab


def test_drop_messages_where_present(chats, ab):
    out = cw.drop_messages({"train": chats([("user", "a")]), "test": ab})
    assert out["train"].columns == ["id"] and out["test"].columns == ["a", "b"]


def test_expressions_see_the_input_row(ab):
    out = cw.apply_transform(ab, {"a": "a + 1", "old": "a"})
    assert sorted(tuple(r) for r in out.collect()) == [(2, "x", 1), (3, "y", 2)]


def test_batch_transform_merges_columns(ab):
    def fn(batch):
        return batch.assign(a=batch["a"] * 10, c=batch["b"] + "!")[["c", "a"]]

    out = cw.apply_transform(ab, cw.BatchTransform(fn, "a int, c string"))
    assert out.columns == ["a", "b", "c"]
    assert sorted(tuple(r) for r in out.collect()) == [(10, "x", "x!"), (20, "y", "y!")]


def test_row_callback_builds_conversations(ab):
    def fn(row):
        return {"messages": [{"role": "user", "content": row["b"]}]}

    schema = "messages array<struct<role:string,content:string>>"
    out = cw.apply_transform(ab, cw.RowTransform(fn, schema)).orderBy("a").collect()
    assert [(r.a, r.b, r.messages[0].content) for r in out] == [(1, "x", "x"), (2, "y", "y")]


def test_row_callback_sees_nested_values(chats):
    def fn(row):
        messages = row["messages"]
        return {"n": len(messages) if messages else None}

    df = chats([("user", "a"), ("assistant", "b")], None)
    out = cw.apply_transform(df, cw.RowTransform(fn, "n int")).orderBy("id").collect()
    assert [r.n for r in out] == [2, None]


def test_row_callback_keeps_nulls_and_types(spark):
    df = spark.sql("SELECT * FROM VALUES (1L, NULL, date'2024-01-02'), (NULL, 2.5D, NULL) AS t(a, b, d)")
    seen = cw.RowTransform(lambda row: {"b": row["b"], "t": type(row["a"]).__name__}, "b double, t string")
    rows = {tuple(r) for r in cw.apply_transform(df, seen).collect()}
    assert rows == {(r.a, r.b, r.d, "int" if r.a else "NoneType") for r in df.collect()}


def test_row_callback_with_undeclared_columns(ab):
    out = cw.apply_transform(ab, cw.RowTransform(lambda row: {"z": 1}, "a int"))
    with pytest.raises(Exception, match="undeclared columns"):
        out.collect()


def test_batch_transform_must_keep_the_rows(ab):
    out = cw.apply_transform(ab, cw.BatchTransform(lambda b: b.head(0), "a int"))
    with pytest.raises(Exception, match="maps each row to one row"):
        out.collect()


def test_batch_transform_keeps_untouched_values_and_matches_by_index(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 9007199254740993L), (2, NULL), (3, 9007199254740995L) AS t(a, big)").coalesce(1)

    def fn(batch):
        assert str(batch["big"].dtype) == "Int64"
        return batch.assign(c=batch["a"] * 10).iloc[::-1]

    out = cw.apply_transform(df, cw.BatchTransform(fn, "c int"))
    assert {tuple(r) for r in out.collect()} == {(1, 9007199254740993, 10), (2, None, 20), (3, 9007199254740995, 30)}


@pytest.mark.parametrize(
    "fn, message",
    [
        (lambda b: b.assign(z=1, c=1), "undeclared columns"),
        (lambda b: b, "left out"),
        (lambda b: b.assign(c=1).set_index(b["a"] + 100), "another index"),
    ],
)
def test_batch_transform_with_wrong_columns_or_index(ab, fn, message):
    with pytest.raises(Exception, match=message):
        cw.apply_transform(ab, cw.BatchTransform(fn, "c int")).collect()


@pytest.mark.parametrize("transform", [{}, None, "def f(x): return x"])
def test_no_transform_found(ab, transform):
    with pytest.raises(ValueError):
        cw.apply_transform(ab, transform)


def test_contracts(chats, ab):
    assert cw.task_columns(chats([("user", "a")]), "sft", ("id",)).columns == ["id", "messages"]
    for df, task in [(ab, "sft"), (ab, "preference"), (ab.withColumn("messages", F.lit("x")), "sft")]:
        with pytest.raises(ValueError):
            cw.check_contract(df, task)
    with pytest.raises(ValueError):
        cw.check_contract(ab, "other")
