"""Split tables out: ordered files per split, and row counts as metrics."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import POSITION_BITS, position

# Metric names by split.
METRIC_NAMES = {"train": "train_samples", "test": "eval_samples"}

# Save mode that replaces the written splits only.
OVERWRITE_SPLITS = "overwrite_splits"


def write_splits(
    splits: Mapping[str, DataFrame],
    path: str,
    *,
    order_key: str | None = None,
    files: int | Mapping[str, int] | None = None,
    mode: str = "errorifexists",
    format: str = "parquet",
) -> dict[str, int]:
    """Write the splits as partitions of one table; returns the rows written by split.

    ``mode`` is a save mode of Spark, or ``OVERWRITE_SPLITS``: the splits that are written replace those of the same
    name and others stay as they are, file by file. A split without rows replaces nothing.

    With ``order_key`` (an md5 digest column) the rows of a split are in key
    order within and across its files, cut into ``files`` even ranges. Digests
    are uniform, so the ranges need no sampling pass; one exchange results.
    """
    frame = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [df.withColumn("split", F.lit(name)) for name, df in splits.items()],
    )
    return write_marked(
        frame, path, names=list(splits), order_key=order_key, files=files, mode=mode, format=format
    )


def write_marked(
    frame: DataFrame,
    path: str,
    *,
    names: list[str],
    order_key: str | None = None,
    files: int | Mapping[str, int] | None = None,
    mode: str = "errorifexists",
    format: str = "parquet",
) -> dict[str, int]:
    """As :func:`write_splits`, for one frame with a ``split`` column: one pass.

    Rows are counted by ``observe`` in the tasks that write them, behind the last exchange. Spark takes the counts of
    each such task once, whether it was tried again or run twice, so they are those of the files.
    """
    if order_key is not None:
        frame = _in_order(frame, names, order_key, files)
    seen = Observation()
    # Metrics are named by number, as a split may have any name.
    counts = [F.count_if(F.col("split") == name).alias(f"n{i}") for i, name in enumerate(names)]
    writer = frame.observe(seen, *counts).write.partitionBy("split").format(format)
    if mode == OVERWRITE_SPLITS:
        writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    else:
        writer = writer.mode(mode)
    writer.save(path)
    return {name: seen.get[f"n{i}"] for i, name in enumerate(names)}


def _in_order(
    frame: DataFrame, names: list[str], order_key: str, files: int | Mapping[str, int] | None
) -> DataFrame:
    if files is None:
        files = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per_split = {name: files if isinstance(files, int) else files[name] for name in names}
    # position * n / 2^60 without leaving 64 bits: the top 32 bits suffice.
    top = F.shiftright(position(F.col(order_key)), POSITION_BITS - 32)
    target, first = F.lit(0).cast("bigint"), 0
    for name in names:
        within = F.shiftright(top * per_split[name], 32) + first
        target = F.when(F.col("split") == name, within).otherwise(target)
        first += per_split[name]
    return frame.repartitionById(first, target.cast("int")).sortWithinPartitions(
        "split", order_key
    )


def split_counts(splits: Mapping[str, DataFrame] | DataFrame) -> DataFrame:
    """``(split, rows)``; a split without rows still has its line if given as mapping."""
    if isinstance(splits, DataFrame):
        return splits.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
    return reduce(
        DataFrame.unionAll,
        [
            df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("split"), "rows")
            for name, df in splits.items()
        ],
    )


def write_metrics(counts: DataFrame, path: str, *, mode: str = "errorifexists") -> dict[str, int]:
    """Save ``train_samples`` / ``eval_samples`` as one small JSON file."""
    rows = {r["split"]: r["rows"] for r in counts.select("split", "rows").collect()}  # one row per split
    return save_metrics(counts.sparkSession, rows, path, mode=mode)


def save_metrics(
    spark: SparkSession, rows: Mapping[str, int], path: str, *, mode: str = "errorifexists"
) -> dict[str, int]:
    """Save rows by split, as a write returns them, as one small JSON file."""
    metrics = {METRIC_NAMES.get(split, f"{split}_samples"): n for split, n in rows.items()}
    row = spark.range(1).select(*[F.lit(n).alias(name) for name, n in sorted(metrics.items())])
    row.coalesce(1).write.mode("overwrite" if mode == OVERWRITE_SPLITS else mode).json(path)
    return metrics
