"""Scalar rules of the run catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .globs import matches_any

# The file that marks a finished run, and the reasons given.
FINISHED_MARKER = "train_results.json"
REASON_FINISHED = "found train_results.json"
REASON_UNFINISHED = "missing train_results.json (training not finished or failed)"

# Endings of files worth keeping from a checkpoint.
ARTIFACT_ENDINGS = (".safetensors", ".bin", ".json", ".model", ".jinja", "latest")

# Paths, relative to the run, that are not published.
UPLOAD_IGNORE = ("checkpoint-*", "slurm/**")

# White space as text stripping understands it (Unicode, plus the separators
# U+001C to U+001F).
_BLANK = r"[\s\x1c-\x1f]"


def hub_id(config_json: Column) -> Column:
    """``hub_model_id`` of a config text: trimmed; NULL unless a non-blank string.

    Malformed text, a config that is no mapping and values of other types give
    NULL and never fail the scan.
    """
    value = F.try_variant_get(F.try_parse_json(config_json), "$.hub_model_id", "variant")
    text = F.when(
        F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")
    )
    stripped = F.regexp_replace(text, f"(?U)^{_BLANK}+|{_BLANK}+$", "")
    return F.nullif(stripped, F.lit(""))


def finish_reason(finished: Column) -> Column:
    return F.when(finished, REASON_FINISHED).otherwise(REASON_UNFINISHED)


def submit_status(finished: Column, step: Column) -> Column:
    return (
        F.when(finished, "finished").when(step.isNotNull(), "in progress").otherwise("none")
    )


def publish_status(finished: Column, hub_model_id: Column) -> Column:
    return (
        F.when(finished & hub_model_id.isNotNull(), "ready")
        .when(finished, "finished, no id")
        .otherwise("not finished")
    )


def published_status(hub_model_id: Column, published: Column, *, checked: bool) -> Column:
    if not checked:
        return F.lit("skipped")
    return (
        F.when(hub_model_id.isNull(), "n/a").when(published, "yes").otherwise("no")
    )


def is_publishable(finished: Column, hub_model_id: Column) -> Column:
    return finished & hub_model_id.isNotNull()


def is_resubmittable(finished: Column, script: Column) -> Column:
    return script.isNotNull() & ~finished


def is_artifact(name: Column, patterns: Sequence[str] | None = None) -> Column:
    """Whether a file of a checkpoint is worth keeping: by the endings above, or by patterns instead."""
    if patterns is not None:
        return matches_any(name, patterns)
    hit = F.lit(False)
    for ending in ARTIFACT_ENDINGS:
        hit = hit | F.endswith(name, F.lit(ending))
    return hit


def is_ignored_upload(relative_path: Column, patterns: Sequence[str] = UPLOAD_IGNORE) -> Column:
    """Whether a pattern covers the path; ``*`` crosses directories, and a directory stands for what is below it."""
    return matches_any(relative_path, [p + "*" if p.endswith("/") else p for p in patterns])
