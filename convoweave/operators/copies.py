"""Row identity for tables without a key: content plus copy number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StructType, TimestampType

from ..functions.keys import key_part, quoted
from ..sources.scratch import cut_lineage

# JSON of nested values without loss: microseconds, and no session time zone.
_EXACT_JSON = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "timeZone": "UTC",
}

# A content row expands to at most this many copies inside one task.
COPIES_PER_TASK_ROW = 1 << 16


def content_digest(df: DataFrame) -> Column:
    """md5 over the texts of all columns; rows that differ have different texts."""

    def text(field) -> Column:
        column = F.col(quoted(field.name))
        if isinstance(field.dataType, (ArrayType, StructType)):
            return F.to_json(F.struct(column), _EXACT_JSON)  # escapes control characters itself
        if isinstance(field.dataType, TimestampType):
            column = F.unix_micros(column)
        elif isinstance(field.dataType, BinaryType):
            column = F.hex(column)
        return key_part(column)

    return F.md5(F.concat_ws("\x1f", *map(text, df.schema.fields)))


def with_content_key(
    df: DataFrame, key_col: str, *, copies_per_row: int = COPIES_PER_TASK_ROW
) -> DataFrame:
    """Add a unique text key ``<content md5>:<copy number>``; same bag of rows.

    Equal rows are counted, never gathered: a content that makes up a third of
    the table arrives in the shuffle as one partial count per map task. The
    counted table is written once (its readers make several passes) and expanded
    again; heavy contents are first cut into slices spread over the cluster.
    """
    if any(isinstance(f.dataType, MapType) for f in df.schema.fields):
        raise ValueError("rows with map columns cannot be compared: name key columns instead")
    count, digest, copy, part = "_copies", "_digest", "_copy", "_slice"
    columns = [F.col(quoted(name)) for name in df.columns]
    counted = cut_lineage(
        df.groupBy(*columns)
        .agg(F.count(F.lit(1)).alias(count))
        .withColumn(digest, content_digest(df))
    )
    light = counted.where(F.col(count) <= copies_per_row).withColumn(
        copy, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(count)))
    )
    # The explicit number keeps adaptive execution from merging the slices,
    # which are tiny until they are expanded.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last_slice = F.expr(f"({count} - 1) div {copies_per_row}")
    heavy = (
        counted.where(F.col(count) > copies_per_row)
        .withColumn(part, F.explode(F.sequence(F.lit(0).cast("bigint"), last_slice)))
        .repartition(tasks, digest, part)
        .withColumn(
            copy,
            F.explode(
                F.sequence(
                    F.col(part) * copies_per_row + 1,
                    F.least(F.col(count), (F.col(part) + 1) * copies_per_row),
                )
            ),
        )
        .drop(part)
    )
    return light.unionByName(heavy).select(
        *columns,
        F.concat(F.col(digest), F.lit(":"), F.col(copy).cast("string")).alias(key_col),
    )
