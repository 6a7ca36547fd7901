"""A bitmap of hashed keys, of fixed size, that drops most rows ahead of a shuffle.

It only saves work: rows whose key is in the other table are never dropped, and the
join that follows decides. A table too large for the bitmap fills it up, and then
nothing is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG2_BITS = 26  # a broadcast of 8 MiB, whatever the tables are
_CHUNK = 1 << 15  # bits of one bitmap aggregate


def _slot(hashed: Column) -> Column:
    return F.pmod(hashed, F.lit(1 << LOG2_BITS))


def key_bitmap(hashes: Column, keys: DataFrame) -> DataFrame:
    """``(_chunk, _bits)``: bit ``hash mod 2^26`` of each key, as arrays of 64-bit words."""
    word = "cast(conv(hex(substring(_map, i * 8 + 1, 8)), 16, -10) as bigint)"
    return (
        keys.select(_slot(hashes).alias("_slot"))
        .groupBy(F.floor(F.col("_slot") / _CHUNK).cast("int").alias("_chunk"))
        .agg(F.bitmap_construct_agg(F.col("_slot") % _CHUNK).alias("_map"))
        .select("_chunk", F.expr(f"transform(sequence(0, {_CHUNK // 64 - 1}), i -> {word})").alias("_bits"))
    )


def flag_known(df: DataFrame, hashed: Column, bitmap: DataFrame, flag: str) -> DataFrame:
    """Add ``flag``: false only if the key is surely not in the bitmap's table. Never null."""
    slot = _slot(hashed)
    at = (slot % _CHUNK).cast("int")
    # Bytes of a word come most significant first, bits of a byte least significant first.
    bit = (F.lit(7) - (F.floor(at / 8).cast("int") % 8)) * 8 + at % 8
    found = (
        df.withColumns({"_chunk": F.floor(slot / _CHUNK).cast("int"), "_word": F.floor(at / 64).cast("int"), "_bit": bit})
        .join(F.broadcast(bitmap), "_chunk", "left")
        .withColumn(flag, F.coalesce(F.expr("getbit(_bits[_word], _bit) = 1"), F.lit(False)))
    )
    return found.select(*df.columns, flag)


def keep_known(df: DataFrame, hashed: Column, bitmap: DataFrame) -> DataFrame:
    """The rows that may have their key in the bitmap's table."""
    return flag_known(df, hashed, bitmap, "_known").where("_known").drop("_known")
