"""Packing of tokenised rows into blocks without cutting them: best fit, longest rows first.

Which row lies where depends on lengths only, and there are at most ``block`` of them. So the plan is made from
the histogram of lengths, whatever the number of rows: rows of one length are numbered in a seeded hash order, and
stretches of these numbers are given to stretches of equally filled blocks. A row then finds its slot
from its length and number alone.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import POSITION_BITS, position, row_key, stage_digest
from ..sources.scratch import cut_lineage
from .running import running_start

# Rows of one length are numbered in this many stretches.
_STRETCH_BITS = 10


@dataclass(frozen=True)
class SlotPlan:
    """Where rows go, by length and number; arrays in the order of ``(length, first)``.

    Rows ``first``, ``first + 1``, ... of a length go to blocks ``block``, ``block + 1``, ..., ``each`` to
    every block, the first of them at ``offset``.
    """

    length: np.ndarray
    first: np.ndarray
    each: np.ndarray
    block: np.ndarray
    offset: np.ndarray
    blocks: int

    def slots(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block and offset of rows with these lengths and numbers."""
        # Lengths are looked up first, then the numbers inside the stretches of that length.
        low, high = np.searchsorted(self.length, length, "left"), np.searchsorted(self.length, length, "right")
        while (open_ := high - low > 1).any():
            middle = (low + high) // 2
            later = self.first[np.minimum(middle, len(self.first) - 1)] <= number
            low, high = np.where(open_ & later, middle, low), np.where(open_ & ~later, middle, high)
        inside = number - self.first[low]
        return self.block[low] + inside // self.each[low], self.offset[low] + inside % self.each[low] * length


def plan_slots(counts: Mapping[int, int], block: int) -> SlotPlan:
    """Best-fit-decreasing over a histogram of lengths from 1 to ``block``.

    The same blocks as placing row by row, longest first, each into the fullest block that still takes it. Equally
    filled blocks are handled together: one takes as many rows of a length as fit before the next is touched. What
    room a block has left is then shorter than that length and less than half of what it was, so a block is touched
    at most ``log2(block)`` times and the plan has some ``block * log2(block)`` entries at most.
    """
    if counts and not 1 <= min(counts) <= max(counts) <= block:
        raise ValueError(f"lengths must be from 1 to {block}")
    rooms: list[int] = []  # what is left in blocks, ascending
    held: dict[int, list[tuple[int, int]]] = {}  # room -> (first block, number of blocks)
    entries: list[tuple[int, int, int, int, int]] = []
    made = 0

    def keep(room: int, first: int, number: int) -> None:
        if room and number:
            if room not in held:
                insort(rooms, room)
                held[room] = []
            held[room].append((first, number))

    for length in sorted(counts, reverse=True):
        left, done = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, number = held[room].pop()
                if not held[room]:
                    del held[room], rooms[at]
            else:
                room, first, number = block, made, -(-left // (block // length))
                made += number
            each = room // length
            full = min(number, left // each)
            if full:
                entries.append((length, done, each, first, block - room))
                keep(room - each * length, first, full)
                done, left = done + full * each, left - full * each
            if left and full < number:
                # The last block of this length takes what there is.
                entries.append((length, done, left, first + full, block - room))
                keep(room - left * length, first + full, 1)
                full, done, left = full + 1, done + left, 0
            keep(room, first + full, number - full)
    entries.sort()
    columns = np.array(entries, np.int64).reshape(-1, 5).T
    return SlotPlan(*columns, made)


def pack_whole(
    df: DataFrame,
    key_cols: Sequence[str],
    length: str,
    *,
    block: int,
    seed: int = 0,
    stretch_bits: int = _STRETCH_BITS,
    materialise: bool = False,
) -> DataFrame:
    """One row for each piece: ``block``, ``offset`` in it, and the tokens ``[from, to)`` of the row that lie there.

    A row of up to ``block`` tokens is one piece. A longer one is cut into pieces of ``block`` tokens and the
    rest, which is packed like a row of its own. Rows without tokens (or of null length) have no piece. No block
    holds more than ``block`` tokens. ``key_cols`` must identify rows; which of several rows of one length
    takes which slot follows from the key and ``seed``.

    The driver sees one number per length. Rows are read twice, for the histogram and for their numbers;
    ``materialise`` writes them first, which pays if lengths are costly to compute.
    """
    if df.isStreaming:
        raise ValueError("packing numbers all rows of a length and works on batch data only")
    if block < 1:
        raise ValueError("block must be positive")
    if clash := {"block", "offset", "from", "to"} & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} are made here; rename those of the rows")
    if materialise:
        df = cut_lineage(df)
    size = F.col(length).cast("bigint")
    pieces = df.where(size > 0).withColumn("from", F.explode(F.sequence(F.lit(0), size - 1, F.lit(block))))
    pieces = pieces.withColumn("_size", F.least(size - F.col("from"), F.lit(block)).cast("int"))
    counts = {r["_size"]: r["count"] for r in pieces.groupBy("_size").count().collect()}
    plan = plan_slots(counts, block)

    key = row_key(key_cols)
    rows = pieces.withColumns({"_digest": stage_digest(seed, "pack", "", key), "_key": key, "_one": F.lit(1)})
    numbered = running_start(
        rows,
        group=["_size"],
        stretch=F.shiftright(position(F.col("_digest")), POSITION_BITS - stretch_bits),
        order=["_digest", "_key", "from"],
        value="_one",
        out="_number",
    )

    @F.arrow_udf("struct<block:bigint,offset:int>")
    def slot(sizes: pa.Array, numbers: pa.Array) -> pa.Array:
        found = plan.slots(*(x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (sizes, numbers)))
        return pa.StructArray.from_arrays([pa.array(found[0]), pa.array(found[1].astype(np.int32))], ["block", "offset"])

    placed = numbered.withColumn("_slot", slot(F.col("_size"), F.col("_number")))
    return placed.select(
        *df.columns,
        F.col("_slot.block").alias("block"),
        F.col("_slot.offset").alias("offset"),
        F.col("from").cast("bigint").alias("from"),
        (F.col("from") + F.col("_size")).cast("bigint").alias("to"),
    )


def whole_blocks(placed: DataFrame, tokens: str) -> DataFrame:
    """``(block, tokens, lengths)``: the tokens of each block, and of how many tokens its pieces are, in order.

    A group holds at most one block of tokens, so none can outgrow its task.
    """
    first, last = F.col("from"), F.col("to")
    piece = F.struct("offset", F.slice(tokens, (first + 1).cast("int"), (last - first).cast("int")).alias("t"))
    return (
        placed.select("block", piece.alias("piece"))
        .groupBy("block")
        .agg(F.array_sort(F.collect_list("piece")).alias("_pieces"))
        .select(
            "block",
            F.flatten(F.transform("_pieces", lambda p: p["t"])).alias("tokens"),
            F.transform("_pieces", lambda p: F.size(p["t"])).alias("lengths"),
        )
    )
