"""Run tables kept bucketed by path, for questions that are asked again and again.

Summaries, configs and listings of markers all join by the path of a run. Written once in buckets of that path, sorted,
each later join and each aggregation by path reads its buckets where they lie instead of shuffling them anew.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..sources.scratch import scratch_path


def keep_by_path(
    df: DataFrame, *, column: str = "path", buckets: int = 64, name: str | None = None, location: str | None = None
) -> DataFrame:
    """``df`` as a table bucketed and sorted by ``column``, one file per bucket.

    Tables that are to be joined must have the same number of buckets; take as many as keep a bucket below a few hundred MB.
    ``name`` and ``location`` are those of the catalogue table; by default it gets a new name and lies in the shared
    scratch folder. One shuffle, here; a table of that name is replaced.
    """
    if buckets < 1:
        raise ValueError("buckets must be positive")
    spark = df.sparkSession
    name = name or f"kept_{uuid.uuid4().hex}"
    (
        df.repartition(buckets, column)
        .write.format("parquet")
        .bucketBy(buckets, column)
        .sortBy(column)
        .option("path", location or scratch_path(spark, "bucketed"))
        .mode("overwrite")
        .saveAsTable(name)
    )
    return spark.table(name)
