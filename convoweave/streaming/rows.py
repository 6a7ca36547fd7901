"""The row-local part of the mixture and of rendering, on streams.

Sampling, splitting, packing and assembling messages need whole tables or
groups; their operators refuse streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.chat import render_chat
from ..operators.member_steps import initial_columns, reshape
from ..plans.training_text import split_invalid
from ..sources.tables import FORMATS
from ..spec import Member


def stream_table(
    spark: SparkSession,
    folder: str,
    schema: StructType,
    *,
    format: str = "parquet",
    files: str | None = None,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """A folder of files as a stream; ``files`` is a glob on their names."""
    if format not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}, got {format!r}")
    reader = spark.readStream.format(format).schema(schema)
    if files is not None:
        reader = reader.option("pathGlobFilter", files)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(folder)


def stream_member(stream: DataFrame, member: Member) -> DataFrame:
    """Projection, rename, transform and filter of a member, without sampling."""
    if member.weight not in (None, 1):
        raise ValueError("sampling by weight works on batch data only")
    return reshape(initial_columns(stream, member), member)


def stream_text(stream: DataFrame, *, eos: str, add_generation_prompt: bool = False) -> DataFrame:
    """Render valid conversations; invalid ones can be taken by a second query."""
    valid, _ = split_invalid(stream, ["messages"])
    return valid.withColumn(
        "text", render_chat(F.col("messages"), eos, add_generation_prompt)
    ).drop("messages")


def run_available(stream: DataFrame, path: str, checkpoint: str, *, format: str = "parquet") -> None:
    """Write everything the source holds now, exactly once, and stop."""
    query = (
        stream.writeStream.format(format)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
