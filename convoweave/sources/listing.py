"""Inventory tables: file listings and run configs."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.status import hub_id

KINDS = ("sft", "dpo")


def run_entries(
    listing: DataFrame,
    *,
    results_root: str = "results",
    scripts_root: str | None = "recipes/dpo",
    script_kind: str = "dpo",
    keep: Sequence[str] = (),
) -> DataFrame:
    """``(kind, run, rest, path, is_dir, is_override, *keep)`` from a listing ``(path, is_dir)``.

    ``rest`` is the path below the run, NULL for the run directory. Hidden runs
    and plain files beside the runs are left out. Script files directly under
    ``scripts_root`` come along as overrides for the run they are named after.
    The prefixes reach the scan as filters, so foreign files are not read.
    """
    below = f"{results_root.rstrip('/')}/"
    path = F.col("path")
    in_results = F.startswith(path, F.lit(below))
    wanted = in_results
    parts = F.split(F.substring(path, len(below) + 1, 1 << 30), "/", 3)
    if scripts_root is not None:
        scripts = f"{scripts_root.rstrip('/')}/"
        name = F.regexp_extract(
            F.substring(path, len(scripts) + 1, 1 << 30), r"^([^/]*)\.sh\z", 1
        )
        wanted = in_results | F.startswith(path, F.lit(scripts))
        parts = F.when(in_results, parts).otherwise(F.array(F.lit(script_kind), name))
    # Unpacked through a generator, the path is taken apart once per row; as a
    # plain projection every later filter would repeat it.
    found = listing.where(wanted).select(
        "path", "is_dir", *keep, F.explode(F.array(parts)).alias("_parts")
    )
    return found.select(
        F.get("_parts", F.lit(0)).alias("kind"),
        F.get("_parts", F.lit(1)).alias("run"),
        F.get("_parts", F.lit(2)).alias("rest"),
        "path",
        "is_dir",
        (~in_results).alias("is_override"),
        *keep,
    ).where(
        F.col("kind").isin(*KINDS)
        & (F.col("run") != "")
        & ~F.startswith("run", F.lit("."))
        & F.when(F.col("is_override"), ~F.col("is_dir")).otherwise(
            F.col("rest").isNotNull() | F.col("is_dir")
        )
    )


def run_configs(configs: DataFrame) -> DataFrame:
    """``(run, hub_model_id)`` from ``(run, config_json)``; ``run`` is the run's path."""
    return configs.select("run", hub_id(F.col("config_json")).alias("hub_model_id"))


def scan_configs(spark: SparkSession, root: str, name: str = "config.yaml") -> DataFrame:
    """``(run, config_json)`` from the config file in each run directory below ``root``.

    YAML files are turned into JSON text; this needs PyYAML on the executors.
    JSON files are taken as they are.
    """
    text = _files(spark, root, name).select(
        _below(F.col("path"), root).alias("path"), F.col("content").cast("string").alias("text")
    )
    run = F.expr(f"substring(path, 1, length(path) - {len(name) + 1})")
    config = _yaml_to_json(F.col("text")) if name.endswith((".yaml", ".yml")) else F.col("text")
    return text.select(run.alias("run"), config.alias("config_json"))


def _files(spark: SparkSession, root: str, name: str = "*") -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", name)
        .load(root)
    )


def _below(path: Column, root: str) -> Column:
    """Path relative to ``root``, whether or not it carries a scheme."""
    plain = re.sub(r"^[a-z0-9+.-]+:/*", "/", root).rstrip("/")
    return F.regexp_extract(path, rf"\Q{plain}\E/(.*)\z", 1)


def _yaml_to_json(text: Column) -> Column:
    @F.pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        import json
        import math

        import yaml

        def plain(value):
            """As JSON has it: textual keys, null for numbers it cannot write, text for the rest."""
            if isinstance(value, dict):
                return {str(k): plain(v) for k, v in value.items()}
            if isinstance(value, (list, tuple, set)):
                return [plain(v) for v in value]
            if isinstance(value, float) and not math.isfinite(value):
                return None
            return value if value is None or isinstance(value, (bool, int, float, str)) else str(value)

        def one(text):
            # A file that cannot be read is a run without config, whatever is wrong with it.
            try:
                return json.dumps(plain(yaml.safe_load(text)))
            except Exception:
                return None

        return texts.map(one)

    return convert(text)
