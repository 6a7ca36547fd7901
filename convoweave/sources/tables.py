"""Scans of named datasets below a configured root."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..spec import Member

FORMATS = ("parquet", "json", "csv")
# More values than that and a column is no split column.
MAX_SPLITS = 1000


def dataset_path(
    root: str, name: str, config: str | None = None, data_dir: str | None = None
) -> str:
    parts = (part.strip("/") for part in (name, config, data_dir) if part)
    return "/".join([root.rstrip("/"), *parts])


def read_table(
    spark: SparkSession,
    path: str,
    format: str = "parquet",
    options: Mapping[str, str] | None = None,
    schema: str | StructType | None = None,
) -> DataFrame:
    """A table of files. Give the schema of large JSON and CSV data: inferring it
    is a pass over everything."""
    if format not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}, got {format!r}")
    reader = spark.read.format(format).options(**(options or {}))
    return (reader if schema is None else reader.schema(schema)).load(path)


def load_dataset(
    spark: SparkSession,
    name: str,
    config: str | None = None,
    *,
    root: str,
    format: str = "parquet",
    split_column: str = "split",
    options: Mapping[str, str] | None = None,
    schema: str | StructType | None = None,
) -> dict[str | None, DataFrame]:
    """All splits of a dataset, as they are: nothing sampled, filtered or shuffled.

    Splits are the values of the partition column; finding them reads no data
    column. Data without that column is one ``train`` split. Rows without a value are the
    split ``None``, the last one. More than ``MAX_SPLITS`` values are refused.
    """
    df = read_table(spark, dataset_path(root, name, config), format, options, schema)
    if split_column not in df.columns:
        return {"train": df}
    names = [row[0] for row in df.select(split_column).distinct().limit(MAX_SPLITS + 1).collect()]
    if len(names) > MAX_SPLITS:
        raise ValueError(f"column {split_column!r} of {name!r} has more than {MAX_SPLITS} values, so it names no splits")
    return {
        split: df.where(F.col(split_column).eqNullSafe(F.lit(split))).drop(split_column)
        for split in sorted(names, key=lambda s: (s is None, s))
    }


def load_member(spark: SparkSession, member: Member, root: str) -> DataFrame:
    """One split of a mixture member; on a partition column this prunes directories."""
    df = read_table(
        spark,
        dataset_path(root, member.id, member.config, member.data_dir),
        member.format,
        member.options,
        member.schema,
    )
    return select_split(df, member)


def select_split(df: DataFrame, member: Member) -> DataFrame:
    if member.split_column in df.columns:
        return df.where(F.col(member.split_column) == member.split).drop(member.split_column)
    if member.split != "train":
        raise ValueError(
            f"member {member.id!r} has no column {member.split_column!r}, so it has "
            f"only the split 'train', not {member.split!r}"
        )
    return df
