"""Equi-joins whose left side may have one key on a large share of its rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str,
    *,
    spread_by: Column,
    salts: int,
) -> DataFrame:
    """Join with the rows of each left key dealt to ``salts`` tasks.

    The right side is repeated for every salt, so it should be the small one;
    ``spread_by`` tells the rows of one key apart. NULL keys are dealt out too.
    Good for inner, left, left-semi and left-anti joins. Adaptive execution
    splits skewed partitions only where both inputs are plain exchanges, which
    an aggregated right side is not.
    """
    salt = "_salt"
    dealt = left.withColumn(salt, F.pmod(F.xxhash64(spread_by), F.lit(salts)))
    repeated = right.withColumn(
        salt, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
    )
    return dealt.join(repeated, [*on, salt], how).drop(salt)
