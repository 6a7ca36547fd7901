"""Dense row numbers, and shuffles and samples that follow from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.permutation import Permutation
from ..sources.scratch import cut_lineage

# monotonically_increasing_id keeps the partition above so many bits of row number.
_ROW_BITS = 33
NUMBER = "_number"


def number_rows(df: DataFrame, order: Sequence[str] | None = None) -> tuple[DataFrame, int]:
    """``df`` with ``_number``, dense from 0, and the number of rows.

    With ``order`` the numbers follow these columns, nulls first: rows are sorted inside ranges, so no task sees more than
    a range, and columns that identify rows make the numbers reproducible. Without it nothing is
    shuffled and the numbers follow the partitions as they are read. The rows are written once (select what you need);
    rows before a partition are a prefix sum over one count per partition, which the driver makes.
    """
    if df.isStreaming:
        raise ValueError("numbering counts whole tables and works on batch data only")
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(df.withColumn(NUMBER, F.monotonically_increasing_id()))
    part = F.shiftright(NUMBER, _ROW_BITS)
    counts = sorted(placed.groupBy(part.alias("part")).count().collect())
    before, total = [], 0
    for row in counts:
        before.append((row["part"], total - (row["part"] << _ROW_BITS)))
        total += row["count"]
    # One row per partition of the table that was written.
    shifts = F.broadcast(df.sparkSession.createDataFrame(before, "_part bigint, _shift bigint"))
    numbered = placed.join(shifts, part == F.col("_part"))
    others = [c for c in placed.columns if c != NUMBER]
    return numbered.select(*others, (F.col(NUMBER) + F.col("_shift")).alias(NUMBER)), total


def shuffle_rows(df: DataFrame, order: Sequence[str] | None = None, *, seed: int, out: str = "place") -> DataFrame:
    """``df`` with ``out``, the dense place of each row in an order shuffled by ``seed``.

    A reader that wants the rows ``i`` to ``j`` of the shuffled order filters by ``out``; nothing is sorted by it.
    """
    numbered, n = number_rows(df, order)
    placed = Permutation(n, seed).place(F.col(NUMBER))
    return numbered.withColumn(out, placed).drop(NUMBER)


def sample_rows(df: DataFrame, order: Sequence[str] | None = None, *, fraction: float, seed: int) -> DataFrame:
    """Exactly ``int(n * fraction)`` rows, drawn by ``seed``; samples of one seed are nested."""
    if not 0 <= fraction <= 1:
        raise ValueError(f"fraction must be from 0 to 1, got {fraction}")
    numbered, n = number_rows(df, order)
    kept = Permutation(n, seed).place(F.col(NUMBER)) < int(n * fraction)
    return numbered.where(kept).drop(NUMBER)
