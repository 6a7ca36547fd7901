"""Table contracts of the training tasks, checked on the schema alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

TASK_COLUMNS = {"sft": ("messages",), "preference": ("chosen", "rejected")}

# Split names by task.
SPLIT_NAMES = (
    "train_sft", "test_sft", "train_gen", "test_gen", "train_prefs", "test_prefs",
)


def check_contract(df: DataFrame, task: str) -> DataFrame:
    """The frame itself, or ValueError naming what the task misses."""
    if task not in TASK_COLUMNS:
        raise ValueError(f"task must be one of {sorted(TASK_COLUMNS)}, got {task!r}")
    for name in TASK_COLUMNS[task]:
        if name not in df.columns:
            raise ValueError(f"{task} data needs a column {name!r}; columns are {df.columns}")
        if not _is_conversation(df.schema[name].dataType):
            raise ValueError(
                f"{task} column {name!r} must be array<struct<role:string,content:string>>, "
                f"not {df.schema[name].dataType.simpleString()}"
            )
    return df


def task_columns(df: DataFrame, task: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Only what the task reads (plus ``keep``), so the scan is pruned to it."""
    check_contract(df, task)
    return df.select(*keep, *TASK_COLUMNS[task])


def _is_conversation(type_: DataType) -> bool:
    return (
        isinstance(type_, ArrayType)
        and isinstance(type_.elementType, StructType)
        and all(
            name in type_.elementType.fieldNames()
            and isinstance(type_.elementType[name].dataType, StringType)
            for name in ("role", "content")
        )
    )
