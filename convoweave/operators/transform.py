"""Per-sample transforms: SQL expressions, or Python over Arrow batches."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.keys import quoted
from ..spec import BatchTransform, ColumnTransform, RowTransform, Transform


def apply_transform(df: DataFrame, transform: Transform) -> DataFrame:
    """One row in, one row out; named columns are replaced or added, others stay.

    Expressions all see the input row, not each other's results.
    """
    if isinstance(transform, BatchTransform):
        return _map_batches(df, transform)
    if isinstance(transform, ColumnTransform):
        return _map_columns(df, transform)
    if isinstance(transform, RowTransform):
        return _map_rows(df, transform)
    if isinstance(transform, Mapping) and transform:
        return df.withColumns({name: F.expr(sql) for name, sql in transform.items()})
    raise ValueError("no transform found: give SQL expressions, a BatchTransform, ColumnTransform or RowTransform")


def _map_columns(df: DataFrame, transform: ColumnTransform) -> DataFrame:
    made = {}
    for name, column in transform.columns.items():
        missing = [c for c in column.inputs if c not in df.columns]
        if missing or not column.inputs:
            raise ValueError(f"column {name!r} is made of {list(column.inputs)}, and there are {df.columns}")
        made[name] = F.arrow_udf(column.fn, column.type)(*[F.col(quoted(c)) for c in column.inputs])
    if not made:
        raise ValueError("no transform found: a ColumnTransform without columns")
    return df.withColumns(made)


def _map_batches(df: DataFrame, transform: BatchTransform) -> DataFrame:
    """Declared columns come from the callback's frame, by index; all others stay in Arrow."""
    result, declared = _result_schema(df, transform.schema)
    fn = transform.fn

    def run(batches):
        import pandas as pd
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(result)
        # Whole numbers and booleans keep their values beside nulls.
        nullable = {
            pa.int8(): pd.Int8Dtype(), pa.int16(): pd.Int16Dtype(), pa.int32(): pd.Int32Dtype(),
            pa.int64(): pd.Int64Dtype(), pa.bool_(): pd.BooleanDtype(),
        }
        for batch in batches:
            if not batch.num_rows:
                continue
            frame = pa.Table.from_batches([batch]).to_pandas(types_mapper=nullable.get)
            out = fn(frame.copy(deep=False))
            if len(out) != len(frame):
                raise ValueError(
                    f"a transform maps each row to one row: {len(frame)} in, {len(out)} out"
                )
            undeclared = [c for c in out.columns if c not in frame.columns and c not in declared]
            missing = [c for c in declared if c not in out.columns]
            if undeclared or missing:
                raise ValueError(
                    f"a transform returned undeclared columns {undeclared} and left out {missing}"
                )
            if not out.index.equals(frame.index):
                if not out.index.is_unique or not out.index.isin(frame.index).all():
                    raise ValueError("a transform returned rows under another index")
                out = out.loc[frame.index]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.Array.from_pandas(out[f.name], type=f.type)
                    if f.name in declared
                    else batch.column(f.name).cast(f.type)
                    for f in schema
                ],
                schema=schema,
            )

    return df.mapInArrow(run, result)


def _map_rows(df: DataFrame, transform: RowTransform) -> DataFrame:
    result, declared = _result_schema(df, transform.schema)
    fn, known = transform.fn, set(declared)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(result)
        for batch in batches:
            rows = []
            for sample in batch.to_pylist():
                changed = fn(dict(sample))
                if not known.issuperset(changed):
                    raise ValueError(
                        f"a transform returned undeclared columns {sorted(set(changed) - known)}"
                    )
                rows.append(sample | changed)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return df.mapInArrow(run, result)


def _result_schema(df: DataFrame, schema: str | StructType) -> tuple[StructType, list[str]]:
    """Input columns in their order, replaced where declared anew, then the added ones."""
    declared = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    anew = {field.name: field for field in declared.fields}
    added = [field for field in declared.fields if field.name not in df.columns]
    kept = [anew.get(field.name, field) for field in df.schema.fields]
    return StructType([*kept, *added]), declared.fieldNames()
