"""Union of members whose nested fields differ, inside structs, arrays and maps."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, NullType, StructField, StructType

from ..functions.keys import quoted


def merge_types(a: DataType, b: DataType, path: str) -> DataType:
    """The type with the fields of both, in the order they are first seen.

    Untyped nulls fit everything. Other types must be equal; an error names the path to the clash. Keys of maps
    must be equal too, as filling their fields could make two keys one.
    """
    if isinstance(a, NullType) or isinstance(b, NullType):
        return b if isinstance(a, NullType) else a
    if isinstance(a, StructType) and isinstance(b, StructType):
        theirs = {f.name: f.dataType for f in b.fields}
        fields = [
            StructField(f.name, merge_types(f.dataType, theirs[f.name], f"{path}.{f.name}") if f.name in theirs else f.dataType)
            for f in a.fields
        ]
        known = set(a.fieldNames())
        return StructType(fields + [StructField(f.name, f.dataType) for f in b.fields if f.name not in known])
    if isinstance(a, ArrayType) and isinstance(b, ArrayType):
        return ArrayType(merge_types(a.elementType, b.elementType, f"{path}[]"))
    if isinstance(a, MapType) and isinstance(b, MapType) and _bare(a.keyType) == _bare(b.keyType):
        return MapType(a.keyType, merge_types(a.valueType, b.valueType, f"{path}{{}}"))
    if _bare(a) != _bare(b):
        raise TypeError(f"{path} is {a.simpleString()} in one member and {b.simpleString()} in another")
    return a


def _bare(type_: DataType) -> str:
    """A type without nullability, which ``simpleString`` does not show."""
    return type_.simpleString()


def conform(value: Column, given: DataType, wanted: DataType) -> Column:
    """``value`` with the fields of ``wanted``, the missing ones null. What is null stays null.

    One expression, without a shuffle or a generator; a part that has its type already is passed on as it is.
    """
    if _bare(given) == _bare(wanted):
        return value
    if isinstance(given, NullType):
        return value.cast(wanted)
    if isinstance(given, ArrayType):
        return F.transform(value, lambda x: conform(x, given.elementType, wanted.elementType))
    if isinstance(given, MapType):
        return F.transform_values(value, lambda _, x: conform(x, given.valueType, wanted.valueType))
    held = {f.name: f.dataType for f in given.fields}
    fields = [
        (conform(value.getField(f.name), held[f.name], f.dataType) if f.name in held else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in wanted.fields
    ]
    return F.when(value.isNotNull(), F.struct(*fields))


def concat_nested(frames: Sequence[DataFrame]) -> DataFrame:
    """Bag union by column name where nested fields may be missing or in another order.

    Missing columns and fields are NULL. Two columns of a member that differ by case only cannot be told apart and
    are an error, as are clashing types.
    """
    if not frames:
        raise ValueError("nothing to concatenate")
    wanted: dict[str, DataType] = {}
    for df in frames:
        for f in df.schema.fields:
            wanted[f.name] = merge_types(wanted.get(f.name, NullType()), f.dataType, f.name)
    folded = [name.lower() for name in wanted]
    if twins := sorted(n for n in wanted if folded.count(n.lower()) > 1):
        raise TypeError(f"columns {twins} differ by case only")

    def reshaped(df: DataFrame) -> DataFrame:
        held = {f.name: f.dataType for f in df.schema.fields}
        return df.select(
            *[
                (conform(F.col(quoted(n)), held[n], t) if n in held else F.lit(None).cast(t)).alias(n)
                for n, t in wanted.items()
            ]
        )

    return reduce(DataFrame.unionAll, map(reshaped, frames))
