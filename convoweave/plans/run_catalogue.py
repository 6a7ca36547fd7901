"""Status of all training runs from a file inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.status import (
    finish_reason,
    publish_status,
    published_status,
    submit_status,
)
from ..operators.catalogue import attach_hub_ids, attach_published, summarise_runs
from ..sources.listing import run_configs, run_entries


def run_status(
    listing: DataFrame,
    configs: DataFrame,
    published: DataFrame | None = None,
    *,
    results_root: str = "results",
    scripts_root: str | None = "recipes/dpo",
) -> DataFrame:
    """One row per run. Without ``published`` that lookup is not in the plan at all."""
    entries = run_entries(listing, results_root=results_root, scripts_root=scripts_root)
    runs = attach_hub_ids(
        summarise_runs(entries, results_root=results_root), run_configs(configs)
    )
    if published is None:
        runs = runs.withColumn("published", F.lit(None).cast("boolean"))
    else:
        runs = attach_published(runs, published)
    finished, hub = F.col("finished"), F.col("hub_model_id")
    return runs.select(
        "kind",
        "run",
        "path",
        "hub_model_id",
        "finished",
        finish_reason(finished).alias("finish_reason"),
        "latest_checkpoint_step",
        "slurm_script",
        "many_scripts",
        "published",
        submit_status(finished, F.col("latest_checkpoint_step")).alias("submit_status"),
        publish_status(finished, hub).alias("publish_status"),
        published_status(hub, F.col("published"), checked=published is not None).alias(
            "published_status"
        ),
    )
