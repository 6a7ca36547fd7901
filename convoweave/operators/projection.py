"""Column steps with the strictness Spark leaves out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, NullType, StructType

from ..functions.keys import quoted


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Project to ``columns``; a name that is not there is an error."""
    missing = [name for name in columns if name not in df.columns]
    if missing:
        raise ValueError(f"no column {missing} among {df.columns}")
    return df.select(*[F.col(quoted(name)) for name in columns])


def rename_sequential(df: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    """Rename one pair after the other, so ``a->b, b->c`` chains.

    A missing source or a taken target is an error; Spark would ignore the one
    and make duplicates of the other. One projection results.
    """
    names = list(df.columns)
    for old, new in renames.items():
        if old not in names:
            raise ValueError(f"cannot rename {old!r}: columns are {names}")
        if new in names:
            raise ValueError(f"cannot rename {old!r} to {new!r}: that column exists")
        names[names.index(old)] = new
    return df.toDF(*names)


def drop_messages(splits: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Preference training has no use for ``messages``; drop it where present."""
    return {name: df.drop("messages") for name, df in splits.items()}


def drop_empty_conversations(df: DataFrame) -> DataFrame:
    """Drop rows whose ``messages`` is NULL or empty; without the column, none.

    The length is taken from one field of the messages, so that passes which
    only count rows read that field of the files and not the texts.
    """
    if "messages" not in df.columns:
        return df
    element = getattr(df.schema["messages"].dataType, "elementType", None)
    length = F.col("messages")
    if isinstance(element, StructType) and element.fields:
        names = element.fieldNames()
        length = length["role" if "role" in names else names[0]]
    return df.where(F.size(length) > 0)


def concat_members(frames: Sequence[DataFrame]) -> DataFrame:
    """Bag union by column name; missing columns are NULL, clashing types an error.

    Spark would widen clashing types and fail on the first unfit row at run time.
    """
    if not frames:
        raise ValueError("nothing to concatenate")
    types: dict[str, DataType] = {}
    for df in frames:
        for field in df.schema.fields:
            known = types.get(field.name)
            if known is None or isinstance(known, NullType):
                types[field.name] = field.dataType
            elif not _same_type(known, field.dataType):
                raise TypeError(
                    f"column {field.name!r} is {known.simpleString()} in one member and "
                    f"{field.dataType.simpleString()} in another"
                )
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _same_type(a: DataType, b: DataType) -> bool:
    """Equal up to nullability, field order and untyped nulls."""
    if isinstance(a, NullType) or isinstance(b, NullType):
        return True
    if isinstance(a, ArrayType) and isinstance(b, ArrayType):
        return _same_type(a.elementType, b.elementType)
    if isinstance(a, MapType) and isinstance(b, MapType):
        return _same_type(a.keyType, b.keyType) and _same_type(a.valueType, b.valueType)
    if isinstance(a, StructType) and isinstance(b, StructType):
        theirs = {f.name: f.dataType for f in b.fields}
        return set(a.fieldNames()) == set(theirs) and all(
            _same_type(f.dataType, theirs[f.name]) for f in a.fields
        )
    return a == b
