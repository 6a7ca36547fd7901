"""Reliable shared storage for intermediate results."""

from __future__ import annotations

import gc
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class _Open(threading.local):
    """Paths that ``cut_lineage`` wrote inside this thread's calls of ``settle`` that are under way, innermost last."""

    def __init__(self) -> None:
        self.calls: list[list[str]] = []


_OPEN = _Open()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder of the cluster: ``spark.checkpoint.dir``, or the session's checkpoint folder.

    There is no default: a machine-local path would be lost with its executor.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    if context.getCheckpointDir() is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an intermediate result to shared storage and read on from there.

    A parquet table rather than ``checkpoint()``, because later passes then read
    only the columns they use. It outlives the executors; like checkpoints it
    is left for the owner of the folder to clear, but for what ``settle`` drops.
    """
    path = scratch_path(df.sparkSession, "part")
    df.write.parquet(path)
    if _OPEN.calls:
        _OPEN.calls[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Have the shuffle files of finished jobs dropped, which stay until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settle[T: (DataFrame, tuple[DataFrame, ...])](spark: SparkSession, build: Callable[[], T]) -> T:
    """What ``build`` returns, one frame or several; of the tables it wrote by ``cut_lineage`` those that they do not read are dropped.

    Nothing else that reads those tables may be kept from inside ``build``.
    """
    _OPEN.calls.append([])
    try:
        result = build()
    finally:
        made = _OPEN.calls.pop()
    files = [f for df in (result if isinstance(result, tuple) else (result,)) for f in df.inputFiles()]
    for path in made:
        name = path.rpartition("/")[2]
        if not any(f"/{name}/" in f for f in files):
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        elif _OPEN.calls:
            _OPEN.calls[-1].append(path)
    release(spark)
    return result
