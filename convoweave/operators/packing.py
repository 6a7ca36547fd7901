"""Packing of tokenised rows into blocks of fixed length.

Each shard is one stream of tokens cut every ``block`` tokens; a row may run on
into the next block. Rows follow each other in a seeded hash order (or in the
order of a dense integer column).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import POSITION_BITS, position, row_key, stage_digest
from ..sources.scratch import cut_lineage
from .running import running_start

# Each shard's order is summed in this many stretches (hash order) ...
_STRETCH_BITS = 10
# ... or in stretches of this many consecutive integers.
_INTEGER_STRETCH_BITS = 20
# Offsets of up to this many (shard, stretch) pairs may be broadcast.
_BROADCAST_STRETCHES = 1 << 18


def pack(
    df: DataFrame,
    key_cols: Sequence[str],
    length: str,
    *,
    block: int,
    shards: int,
    seed: int = 0,
    order: str | None = None,
    shard: Column | None = None,
    stretch_bits: int | None = None,
    materialise: bool = False,
) -> DataFrame:
    """Add ``shard``, ``start``, ``block`` and ``offset`` of each row's first token.

    By default shard and order derive from the md5 of the key. ``order`` names
    an integer column instead, unique within its shard and without wide gaps;
    ``shard`` gives the shard number as an expression below ``shards``.

    The rows are read twice, for totals and for places. ``materialise`` writes
    them to shared storage first, which pays if lengths are costly to compute.
    """
    if df.isStreaming:
        raise ValueError("packing orders whole shards and works on batch data only")
    if block < 1 or shards < 1:
        raise ValueError("block and shards must be positive")
    if materialise:
        df = cut_lineage(df)
    key = row_key(key_cols)
    digest = "_digest"
    rows = df.withColumn(digest, stage_digest(seed, "pack", "", key)).withColumn("_key", key)
    place = position(F.col(digest))
    rows = rows.withColumn(
        "shard", ((place % shards) if shard is None else shard).cast("int")
    )
    if order is None:
        bits = _STRETCH_BITS if stretch_bits is None else stretch_bits
        stretch = F.shiftright(place, POSITION_BITS - bits)
        by, few = [digest, "_key"], shards << bits <= _BROADCAST_STRETCHES
    else:
        bits = _INTEGER_STRETCH_BITS if stretch_bits is None else stretch_bits
        stretch = F.shiftright(F.col(order).cast("bigint"), bits)
        by, few = [order], False
    placed = running_start(
        rows,
        group=["shard"],
        stretch=stretch,
        order=by,
        value=length,
        out="start",
        small_offsets=few,
    )
    return placed.select(
        *df.columns,
        "shard",
        F.col("start").cast("bigint").alias("start"),
        F.expr(f"start div {block}").alias("block"),
        (F.col("start") % block).cast("int").alias("offset"),
    )


def pack_segments(placed: DataFrame, length: str, *, block: int) -> DataFrame:
    """One row per (row, block it reaches into) with the token range ``[from, to)``
    that lies there. Rows without tokens have no segment."""
    last = F.expr(f"(start + `{length}` - 1) div {block}")
    first_token = F.col("block") * block - F.col("start")
    return (
        placed.where(F.col(length) > 0)
        .withColumn("block", F.explode(F.sequence(F.col("block"), last)))
        .withColumn("from", F.greatest(first_token, F.lit(0)).cast("int"))
        .withColumn("to", F.least(first_token + block, F.col(length)).cast("int"))
        .withColumn("offset", F.greatest(-first_token, F.lit(0)).cast("int"))
    )


def pack_blocks(placed: DataFrame, tokens: str, *, block: int) -> DataFrame:
    """Token arrays per ``(shard, block)``; only the last block of a shard is short.

    A group holds at most ``block`` tokens, so none can outgrow its task.
    """
    counted = placed.withColumn("_length", F.size(tokens))
    pieces = pack_segments(counted, "_length", block=block).select(
        "shard",
        "block",
        F.struct(
            "offset", F.slice(tokens, F.col("from") + 1, F.col("to") - F.col("from")).alias("t")
        ).alias("piece"),
    )
    return pieces.groupBy("shard", "block").agg(
        F.flatten(
            F.transform(F.array_sort(F.collect_list("piece")), lambda piece: piece["t"])
        ).alias("tokens")
    )
