"""The run catalogue kept up to date from a stream of file entries.

Rows ``(path, is_dir, ts)`` arrive as files appear. What is known of a run is whether it is finished, its latest
checkpoint, its scripts, how many files it has. All of it is a maximum, a minimum or a sum, so a run may be
split into parts by a hash of the path, and a run that owns a third of all entries is spread over tasks. Each batch
appends, for every part it has new entries of, a row with what these say; file sinks take appended rows only, and write
each of them exactly once. ``current_runs`` puts the rows together, which
gives what ``summarise_runs`` gives on the same entries as a table. The one thing remembered is which paths were seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.status import FINISHED_MARKER
from ..sources.listing import run_entries

UPDATES = """
    kind string, run string, part int, version bigint, listed boolean, finished boolean, step bigint,
    first_script string, last_script string, override string, files bigint, last_new timestamp
"""
_KEYS = ["kind", "run", "part"]
# How two rows of a part become one.
_FOLD = {
    "listed": "max", "finished": "max", "step": "max", "first_script": "min", "last_script": "max",
    "override": "min", "files": "sum", "last_new": "max",
}
# A task folds its rows whenever it holds so many, and gives out parts when it holds that many of them.
_ROWS_AT_ONCE = 1 << 17

_CHECKPOINT = r"^checkpoint-([0-9]+)\z"
_SCRIPT = r"^slurm/[^/]*\.sh\z"


def stream_runs(
    listing: DataFrame,
    *,
    ts: str = "ts",
    repeats_within: str = "1 day",
    parts: int = 16,
    results_root: str = "results",
    scripts_root: str | None = "recipes/dpo",
    script_kind: str = "dpo",
) -> DataFrame:
    """Stream of ``UPDATES`` rows from a stream ``(path, is_dir, ts)``; write it with ``run_available``.

    An entry that is listed again within ``repeats_within`` of its first row counts once. Rows older than the
    latest ``ts`` seen by more than that are late and dropped, and what is remembered of paths is dropped with
    them, so state grows with one such span of paths. Rows without a path or without a time are dropped.
    A path that comes back after the span is a file again in ``files``; nothing else changes by it.
    """
    if not listing.isStreaming:
        raise ValueError("a table of entries is answered by summarise_runs")
    timed = listing.where(F.col("path").isNotNull() & F.col(ts).isNotNull()).select(
        "path", F.coalesce("is_dir", F.lit(False)).alias("is_dir"), F.col(ts).cast("timestamp").alias("ts")
    )
    # Other entries are dropped before their paths would be remembered, but their times count.
    entries = run_entries(
        timed.withWatermark("ts", repeats_within),
        results_root=results_root, scripts_root=scripts_root, script_kind=script_kind, keep=["ts"],
    ).dropDuplicatesWithinWatermark(["path", "is_dir"])
    rest, is_dir, override = F.col("rest"), F.col("is_dir"), F.col("is_override")
    checkpoint = is_dir & F.startswith(rest, F.lit("checkpoint-"))
    script = F.when(~override & rest.rlike(_SCRIPT), F.col("path"))
    seen = entries.select(
        "kind",
        "run",
        F.pmod(F.xxhash64("path"), F.lit(parts)).cast("int").alias("part"),
        F.lit(0).cast("bigint").alias("version"),
        (~override).alias("listed"),
        F.coalesce((rest == FINISHED_MARKER) & ~is_dir, F.lit(False)).alias("finished"),
        F.when(checkpoint, F.regexp_extract(rest, _CHECKPOINT, 1).try_cast("bigint")).alias("step"),
        script.alias("first_script"),
        script.alias("last_script"),
        F.when(override, F.col("path")).alias("override"),
        (~override & ~is_dir).cast("bigint").alias("files"),
        F.col("ts").alias("last_new"),
    )
    return seen.repartition(*_KEYS).mapInArrow(_learn, UPDATES)


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the new entries of a batch say of each part; all of a part are in one task.

    ``version`` tells the rows of a part apart: the number of the batch, and how often the task has given out rows.
    """
    return _parts(batches, int(TaskContext.get().getLocalProperty("streaming.sql.batchId")) << 32)


def _parts(batches: Iterator[pa.RecordBatch], version: int, at_once: int = _ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        rows += len(batch)
        if rows < at_once:
            continue
        held = [_folded(held)]
        rows = len(held[0])
        if rows >= at_once // 2:
            yield from _versioned(held[0], version)
            held, rows, version = [], 0, version + 1
    if held:
        yield from _versioned(_folded(held), version)


def _folded(tables: list[pa.Table]) -> pa.Table:
    rows = pa.concat_tables(tables)
    found = rows.group_by(_KEYS).aggregate([*_FOLD.items(), ("version", "max")])
    return pa.table([found[n if n in _KEYS else f"{n}_{_FOLD.get(n, 'max')}"] for n in rows.column_names], rows.schema)


def _versioned(rows: pa.Table, version: int) -> Iterator[pa.RecordBatch]:
    at = rows.column_names.index("version")
    numbers = pa.array([version], pa.int64()).take(pa.array([0] * len(rows)))
    return iter(rows.set_column(at, rows.schema.field(at), numbers).to_batches())


def current_runs(spark: SparkSession, path: str, *, results_root: str = "results") -> DataFrame:
    """One row per run from what ``stream_runs`` has written to ``path``, plus ``n_files`` and ``last_new``, the time of
    the latest entry that was not listed before.

    Runs that only have a script beside the results are not listed.
    """
    updates = spark.read.schema(UPDATES).parquet(path)
    grouped = updates.groupBy("kind", "run").agg(
        F.max("listed").alias("_listed"),
        F.max("finished").alias("finished"),
        F.max("step").alias("latest_checkpoint_step"),
        F.min("first_script").alias("_first"),
        F.max("last_script").alias("_last"),
        F.min("override").alias("_override"),
        F.sum("files").alias("n_files"),
        F.max("last_new").alias("last_new"),
    )
    return grouped.where("_listed").select(
        "kind",
        "run",
        F.concat_ws("/", F.lit(results_root.rstrip("/")), "kind", "run").alias("path"),
        "finished",
        "latest_checkpoint_step",
        F.coalesce("_override", "_first").alias("slurm_script"),
        (F.col("_override").isNull() & F.coalesce(F.col("_first") != F.col("_last"), F.lit(False))).alias("many_scripts"),
        "n_files",
        "last_new",
    )
