"""Running totals over long ordered groups, without one task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running_start(
    df: DataFrame,
    *,
    group: Sequence[str],
    stretch: Column,
    order: Sequence[str],
    value: str,
    out: str,
    small_offsets: bool = False,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all earlier rows of the group.

    ``stretch`` numbers consecutive pieces of the order (it must not decrease
    along ``order``). Rows are summed inside their piece only; what came before
    a piece is the running total over one pre-aggregated row per piece. A group
    with a third of all rows is thus spread over as many tasks as it has pieces.

    ``small_offsets`` asserts that the caller has bounded the number of pieces,
    so that their offsets may be broadcast.
    """
    piece = "_piece"
    rows = df.withColumn(piece, stretch)
    before = Window.partitionBy(*group).orderBy(piece).rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        rows.groupBy(*group, piece)
        .agg(F.sum(value).alias("_total"))
        .select(*group, piece, F.sum("_total").over(before).alias("_offset"))
        # The first piece of a group starts at zero and needs no row here.
        .where(F.col("_offset") > 0)
    )
    if small_offsets:
        offsets = F.broadcast(offsets)
    inside = Window.partitionBy(*group, piece).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return (
        rows.join(offsets, [*group, piece], "left")
        .withColumn(
            out,
            F.coalesce(F.col("_offset"), F.lit(0))
            + F.coalesce(F.sum(value).over(inside), F.lit(0)),
        )
        .select(*df.columns, out)
    )
