"""Questions about training runs, answered from listing, config and publication tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.globs import matches_any
from ..functions.status import (
    FINISHED_MARKER,
    UPLOAD_IGNORE,
    is_artifact,
    is_ignored_upload,
    is_publishable,
    is_resubmittable,
)
from .skew import salted_join

# Tasks that share the runs of one repository id, and the files of one run.
_RUN_SALTS = 16
_FILE_SALTS = 64

_CHECKPOINT = r"^checkpoint-([0-9]+)\z"


def summarise_runs(entries: DataFrame, *, results_root: str = "results") -> DataFrame:
    """One row per run: ``finished``, ``latest_checkpoint_step``, scripts.

    Aggregated twice. The first step groups by run and script path (NULL for all
    other files), so its buffers hold only flags and numbers, which Spark keeps
    in a hash table without sorting the listing; each map task sends one partial
    row per run and script, however many files a run has. The second step picks
    the scripts from those few rows.
    """
    rest, is_dir, override = F.col("rest"), F.col("is_dir"), F.col("is_override")
    is_checkpoint = is_dir & F.startswith(rest, F.lit("checkpoint-"))
    step = F.regexp_extract(rest, _CHECKPOINT, 1).try_cast("bigint")
    is_script = (
        F.startswith(rest, F.lit("slurm/"))
        & F.endswith(rest, F.lit(".sh"))
        & ~F.contains(F.substring(rest, len("slurm/") + 1, 1 << 30), F.lit("/"))
    )
    by_script = entries.groupBy(
        "kind", "run", "is_override", F.when(override | is_script, F.col("path")).alias("_script")
    ).agg(
        F.max(F.coalesce((rest == FINISHED_MARKER) & ~is_dir, F.lit(False))).alias("_finished"),
        F.max(F.when(is_checkpoint, step)).alias("_step"),
    )
    grouped = by_script.groupBy("kind", "run").agg(
        F.max(~override).alias("_exists"),
        F.max("_finished").alias("finished"),
        F.max("_step").alias("latest_checkpoint_step"),
        F.min(F.when(~override, F.col("_script"))).alias("_slurm"),
        F.count(F.when(~override, F.col("_script"))).alias("_scripts"),
        F.min(F.when(override, F.col("_script"))).alias("_override"),
    )
    return grouped.where("_exists").select(
        "kind",
        "run",
        F.concat_ws("/", F.lit(results_root.rstrip("/")), "kind", "run").alias("path"),
        "finished",
        "latest_checkpoint_step",
        F.coalesce("_override", "_slurm").alias("slurm_script"),
        # Only a choice that was really made deserves the warning.
        (F.col("_override").isNull() & (F.col("_scripts") > 1)).alias("many_scripts"),
    )


def attach_hub_ids(runs: DataFrame, configs: DataFrame) -> DataFrame:
    """Left join of ``(run, hub_model_id)`` by run path; no config gives NULL.

    A run with several configs has the smallest of their ids and stays one row.
    """
    ids = configs.groupBy(F.col("run").alias("path")).agg(F.min("hub_model_id").alias("hub_model_id"))
    return runs.join(ids, "path", "left")


def attach_published(runs: DataFrame, published: DataFrame, *, out: str = "published") -> DataFrame:
    """Whether the run's id is among ``published(repo_id)``: true, false, or NULL without id.

    Many runs may share an id or have none, hence the salts.
    """
    known = published.select(F.col("repo_id").alias("hub_model_id")).distinct()
    looked_up = salted_join(
        runs,
        known.withColumn("_known", F.lit(True)),
        ["hub_model_id"],
        "left",
        spread_by=F.col("path"),
        salts=_RUN_SALTS,
    )
    return looked_up.withColumn(
        out, F.when(F.col("hub_model_id").isNotNull(), F.col("_known").isNotNull())
    ).drop("_known")


def exclude_published(runs: DataFrame, published: DataFrame) -> DataFrame:
    """Drop runs known to be published; runs without an id stay."""
    known = published.select(F.col("repo_id").alias("hub_model_id")).distinct()
    return salted_join(
        runs, known, ["hub_model_id"], "left_anti", spread_by=F.col("path"), salts=_RUN_SALTS
    )


def exclude_finished(runs: DataFrame) -> DataFrame:
    return runs.where(~F.col("finished"))


def publishable(runs: DataFrame) -> DataFrame:
    return runs.where(is_publishable(F.col("finished"), F.col("hub_model_id")))


def resubmittable(runs: DataFrame) -> DataFrame:
    return runs.where(is_resubmittable(F.col("finished"), F.col("slurm_script")))


def finished_runs(runs: DataFrame, listing: DataFrame) -> DataFrame:
    """Runs ``(path, ...)`` whose directory holds the marker file (left-semi join)."""
    suffix = f"/{FINISHED_MARKER}"
    markers = listing.where(F.endswith("path", F.lit(suffix)) & ~F.col("is_dir")).select(
        F.expr(f"substring(path, 1, length(path) - {len(suffix)})").alias("path")
    )
    return runs.join(markers, "path", "left_semi")


def catalogue_counts(runs: DataFrame) -> DataFrame:
    """One row of counts; needs the columns of a full run status."""
    finished, script = F.col("finished"), F.col("slurm_script")
    return runs.agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(finished).alias("finished"),
        F.count_if(is_publishable(finished, F.col("hub_model_id"))).alias("publishable"),
        F.count_if(is_resubmittable(finished, script)).alias("resubmittable"),
        F.count_if(finished & script.isNotNull()).alias("skipped_finished"),
        F.count_if(F.coalesce(F.col("published"), F.lit(False))).alias("published"),
    )


def in_listing_order(runs: DataFrame) -> DataFrame:
    """Kind sft before dpo, then names without regard to case."""
    return runs.orderBy(
        F.when(F.col("kind") == "sft", 0).otherwise(1), F.lower("run"), "run"
    )


def artifact_manifest(
    entries: DataFrame, *, results_root: str = "results", keep: Sequence[str] | None = None
) -> DataFrame:
    """``(src, dst)`` for checkpoint files worth keeping; nothing is copied.

    ``keep`` are patterns on file names (``table_patterns`` reads a table of them) in place of the usual endings.
    """
    pattern = r"^checkpoint-([0-9]+)/([^/]+)\z"
    base = F.concat_ws("/", F.lit(results_root.rstrip("/")), "kind", "run", F.lit("artifacts"))
    step, name = (F.regexp_extract("rest", pattern, i) for i in (1, 2))
    return (
        entries.where(~F.col("is_dir") & F.col("rest").rlike(pattern) & is_artifact(name, keep))
        .select(F.col("path").alias("src"), F.concat_ws("/", base, step, name).alias("dst"))
    )


def upload_manifest(
    entries: DataFrame,
    runs: DataFrame,
    *,
    ignore: Sequence[str] = UPLOAD_IGNORE,
    allow: Sequence[str] | None = None,
) -> DataFrame:
    """``(repo_id, src, dst)`` for the files of publishable runs, minus the ignored ones.

    ``ignore`` and ``allow`` are patterns on paths below the run; without ``allow`` all others go along.

    One run may own a large share of the files; its rows are dealt to many tasks.
    """
    files = entries.where(
        ~F.col("is_dir") & F.col("rest").isNotNull() & ~is_ignored_upload(F.col("rest"), ignore)
        & (F.lit(True) if allow is None else matches_any(F.col("rest"), allow))
    ).select("kind", "run", F.col("path").alias("src"), F.col("rest").alias("dst"))
    targets = publishable(runs).select("kind", "run", F.col("hub_model_id").alias("repo_id"))
    return salted_join(
        files, targets, ["kind", "run"], "inner", spread_by=F.col("src"), salts=_FILE_SALTS
    ).select("repo_id", "src", "dst")
