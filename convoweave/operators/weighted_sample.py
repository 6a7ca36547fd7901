"""Samples of exact size with a weight per row.

Every row gets an exponential key, ``-ln(u) / weight`` with ``u`` from the md5 of its key columns; the ``k`` rows with the
smallest keys are a sample without replacement in which rows are drawn in proportion to their weights, and samples
of one seed are nested. The keys follow no known distribution, so their ``k``-th is bracketed by a KLL sketch and
then counted: a pass leaves a thousandth of the rows or so, until what is left can be fetched.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import POSITION_BITS, position, row_key, stage_digest

# Size of the sketch; its rank error is below a thousandth.
_SKETCH = 4096
_ERROR = 0.002
# Rows of a bracket that may be fetched.
_FETCH = 20_000
_BITS = 52


def exponential_key(digest: Column, weight: Column) -> Column:
    """``-ln(u) / weight`` with ``u`` in (0, 1]; null for rows that cannot be drawn (weight null, NaN or 0).

    A negative or infinite weight is an error.
    """
    u = (F.shiftright(position(digest), POSITION_BITS - _BITS) + 1).cast("double") / float(1 << _BITS)
    w = weight.cast("double")
    wrong = F.raise_error(F.concat(F.lit("a weight is "), w.cast("string"))).cast("double")
    return F.when(w.isNull() | F.isnan(w) | (w == 0), None).when((w < 0) | (w == math.inf), wrong).otherwise(-F.ln(u) / w)


def weighted_sample(
    df: DataFrame,
    key_cols: Sequence[str],
    weight: Column | str,
    *,
    k: int | None = None,
    fraction: float | None = None,
    seed: int = 0,
    member: str = "",
) -> DataFrame:
    """``k`` rows, or ``int(n * fraction)`` of the ``n`` that can be drawn; all of those if they are fewer.

    ``key_cols`` must identify rows: which rows are drawn follows from them, the weights and ``seed``. The plan is a
    filter above the scan; two or three passes over key and weight columns find its bound. Nothing is shuffled but sketches.
    """
    if df.isStreaming:
        raise ValueError("a sample of exact size needs the whole table")
    if (k is None) == (fraction is None) or (k or 0) < 0 or not 0 <= (fraction or 0) <= 1:
        raise ValueError("give a size k of 0 or more, or a fraction from 0 to 1")
    weight = F.col(weight) if isinstance(weight, str) else weight
    digest = stage_digest(seed, "weigh", member, row_key(key_cols))
    keyed = df.withColumns({"_digest": digest}).withColumn("_e", exponential_key(F.col("_digest"), weight))
    found = _bound(keyed.select("_e", "_digest").where(F.col("_e").isNotNull()), k, fraction)
    if found is None:
        return df.where(F.lit(False))
    bound, last = found
    # Equal keys are in the order of their digests.
    drawn = (F.col("_e") < bound) | ((F.col("_e") == bound) & (F.col("_digest") <= last))
    return keyed.where(drawn).select(*df.columns)


def _bound(keys: DataFrame, k: int | None, fraction: float | None) -> tuple[float, str] | None:
    """Key and digest of the last row that is drawn."""
    low, high, skipped = -math.inf, math.inf, 0
    e = F.col("_e")
    while True:
        inside = keys.where((e > low) & (e <= high))
        seen = inside.agg(
            F.count(F.lit(1)).alias("n"),
            F.min("_e").alias("least"),
            F.max("_e").alias("most"),
            F.kll_sketch_agg_double("_e", F.lit(_SKETCH)).alias("sketch"),
        ).first()
        n = seen["n"]
        if k is None:
            k = int(n * fraction)
        want = min(k - skipped, n)
        if want <= 0:
            return None
        if n <= _FETCH:
            rows = inside.sort("_e", "_digest").limit(want + 1).collect()
            if len(rows) > want and rows[want] == rows[want - 1]:
                raise ValueError("the key columns do not identify rows: two that are alike lie at the cut")
            return rows[want - 1]["_e"], rows[want - 1]["_digest"]
        if seen["least"] == seen["most"]:
            return seen["least"], _among_equals(inside, want)
        share = want / n
        below, above = _quantiles(keys, seen["sketch"], [share - _ERROR, share + _ERROR])
        below, above = max(below, low), min(above, high)
        if below == above:
            below = math.nextafter(below, -math.inf)
        counts = inside.agg(F.count_if(e <= below).alias("before"), F.count_if(e <= above).alias("within")).first()
        # The sketch errs now and then; the counts say on which side the bound lies then.
        if want <= counts["before"]:
            high = below
        elif want <= counts["within"]:
            low, high, skipped = below, above, skipped + counts["before"]
        else:
            low, skipped = above, skipped + counts["within"]


def _quantiles(keys: DataFrame, sketch: bytes, ranks: Sequence[float]) -> list[float]:
    row = keys.sparkSession.createDataFrame([(bytearray(sketch),)], "sketch binary").select(
        *[F.kll_sketch_get_quantile_double("sketch", F.lit(min(max(r, 0.0), 1.0))) for r in ranks]
    ).first()
    return list(row)


def _among_equals(keys: DataFrame, want: int) -> str:
    """Digest of the ``want``-th of rows whose keys are one value (weights so large that keys vanish)."""
    places = keys.select(position(F.col("_digest")).cast("double").alias("_e"), "_digest")
    edges = places.agg(F.min("_e").alias("least"), F.max("_e").alias("most")).first()
    if edges["least"] == edges["most"]:
        raise ValueError("the key columns do not identify rows")
    return _bound(places, want, None)[1]
