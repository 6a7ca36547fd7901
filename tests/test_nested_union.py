"""Union of nested fields, against plain Python records."""

import pytest
from pyspark.sql.types import ArrayType, LongType, MapType, StringType, StructField, StructType

import convoweave as cw
from convoweave.operators.nested_union import merge_types
from plan_checks import plan_text


def filled(value, type_):
    """A plain value with the fields of a type."""
    if value is None:
        return None
    if isinstance(type_, StructType):
        return {f.name: filled(value.get(f.name), f.dataType) for f in type_.fields}
    if isinstance(type_, ArrayType):
        return [filled(x, type_.elementType) for x in value]
    if isinstance(type_, MapType):
        return {k: filled(x, type_.valueType) for k, x in value.items()}
    return value


MEMBERS = [
    ("id long, m array<struct<role:string,content:string>>", [
        {"id": 1, "m": [{"role": "u", "content": "a"}, None]}, {"id": 2, "m": None}, {"id": 3, "m": []},
    ]),
    ("m array<struct<content:string,tool:struct<name:string,args:map<string,struct<x:long>>>>>, id long", [
        {"id": 4, "m": [{"content": "b", "tool": {"name": "t", "args": {"k": {"x": 1}, "n": None}}}, {"content": None, "tool": None}]},
    ]),
    ("id long, m array<struct<tool:struct<args:map<string,struct<y:array<struct<z:int>>,x:long>>>,role:string>>, extra struct<`a.b`:int>", [
        {"id": 5, "m": [{"tool": {"args": {"k": {"y": [{"z": 1}, None], "x": None}}}, "role": "v"}], "extra": {"a.b": 7}},
        {"id": 6, "m": [{"tool": None, "role": None}], "extra": None},
    ]),
]


def test_missing_and_reordered_fields(spark):
    frames = [spark.createDataFrame(rows, schema) for schema, rows in MEMBERS]
    out = cw.concat_nested(frames)
    assert out.schema["m"].dataType.simpleString() == (
        "array<struct<role:string,content:string,tool:struct<name:string,args:map<string,struct<x:bigint,y:array<struct<z:int>>>>>>>"
    )
    found = {r.id: r.asDict(recursive=True) for r in out.collect()}
    for _, rows in MEMBERS:
        for row in rows:
            assert found[row["id"]] == {f.name: filled(row.get(f.name), f.dataType) for f in out.schema.fields}
    assert "Exchange" not in plan_text(out)


def test_duplicates_and_equal_members_stay(spark):
    one = spark.createDataFrame(MEMBERS[0][1], MEMBERS[0][0])
    assert cw.concat_nested([one, one]).count() == 6 and "transform" not in plan_text(cw.concat_nested([one, one]))


def test_clashes_name_their_path(spark):
    one = spark.createDataFrame([], "m array<struct<t:struct<a:int,b:string>>>")
    with pytest.raises(TypeError, match=r"m\[\]\.t\.a is int in one member and string"):
        cw.concat_nested([one, spark.createDataFrame([], "m array<struct<t:struct<a:string>>>")])
    with pytest.raises(TypeError, match=r"m\[\]\.t is struct"):
        cw.concat_nested([one, spark.createDataFrame([], "m array<struct<t:array<int>>>")])
    with pytest.raises(TypeError, match=r"k is map"):
        cw.concat_nested([spark.createDataFrame([], "k map<string,int>"), spark.createDataFrame([], "k map<int,int>")])
    with pytest.raises(TypeError, match="case only"):
        cw.concat_nested([spark.createDataFrame([], "a int"), spark.createDataFrame([], "A int")])
    with pytest.raises(ValueError):
        cw.concat_nested([])


def test_untyped_nulls_fit_everything(spark):
    one = spark.sql("SELECT 1 AS id, NULL AS m, array(struct(NULL AS x)) AS n")
    two = spark.sql("SELECT 2 AS id, array(struct('u' AS role)) AS m, array(struct(5 AS x, 6 AS y)) AS n")
    rows = {r.id: r for r in cw.concat_nested([one, two]).collect()}
    assert rows[1].m is None and rows[1].n[0].asDict() == {"x": None, "y": None} and rows[2].n[0].y == 6


def test_nullability_does_not_matter():
    a = StructType([StructField("x", LongType(), False)])
    b = StructType([StructField("x", LongType(), True), StructField("y", StringType(), False)])
    merged = merge_types(ArrayType(a, False), ArrayType(b, True), "m")
    assert merged.simpleString() == "array<struct<x:bigint,y:string>>"


def test_a_mixture_may_fill_fields(spark, tmp_path):
    spark.createDataFrame([(1, [{"role": "user", "content": "a"}])], "id long, messages array<struct<role:string,content:string>>").write.parquet(str(tmp_path / "one"))
    spark.createDataFrame([(2, [{"content": "b", "name": "n", "role": "user"}])], "id long, messages array<struct<content:string,name:string,role:string>>").write.parquet(str(tmp_path / "two"))
    spec = {"datasets": [{"id": n, "key": ["id"], "columns": ["id", "messages"]} for n in ("one", "two")], "seed": 1}
    mixture = cw.Mixture.from_dict(spec)
    with pytest.raises(TypeError):
        cw.plan_mixture(spark, mixture, str(tmp_path))
    frame = cw.plan_mixture(spark, mixture, str(tmp_path), fill_nested=True).frame
    assert {r.id: [m.asDict() for m in r.messages] for r in frame.collect()} == {
        1: [{"role": "user", "content": "a", "name": None}], 2: [{"role": "user", "content": "b", "name": "n"}],
    }
