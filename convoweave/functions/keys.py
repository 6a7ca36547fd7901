"""Deterministic row keys: order, sampling and splitting all derive from md5.

md5 rather than a Spark-only hash, so that any SQL engine can reproduce which
rows were taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The leading 15 hex digits of a digest are read as a position in [0, 2^60).
POSITION_DIGITS = 15
POSITION_BITS = 4 * POSITION_DIGITS
POSITIONS = 1 << POSITION_BITS

_NULL = "\\N"
_SEPARATOR = "\x1f"


def key_part(value: Column) -> Column:
    """Text of a key value that is no other value's: NULL is ``\\N``, and a backslash or separator
    inside a text is escaped, so that joined parts can be told apart."""
    text = F.replace(value.cast("string"), F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit(_SEPARATOR), F.lit("\\s"))
    return F.coalesce(text, F.lit(_NULL))


def row_key(columns: Sequence[str]) -> Column:
    """Text identity of a row from its key columns, taken literally; different rows differ."""
    parts = [key_part(F.col(quoted(name))) for name in columns]
    return parts[0] if len(parts) == 1 else F.concat_ws(_SEPARATOR, *parts)


def quoted(name: str) -> str:
    """A column name as it is, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def stage_digest(seed: int, stage: str, member: Column | str, key: Column) -> Column:
    """Hex digest that orders rows for one stage.

    Each stage has a salt of its own: with a shared digest the rows kept by a
    low weight would all have low digests and land on the same side of a split.
    """
    name = F.lit(member) if isinstance(member, str) else member
    return F.md5(F.concat(F.lit(f"{seed}:{stage}:"), name, F.lit(":"), key))


def position(digest: Column) -> Column:
    """Digest as a bigint spread evenly over [0, 2^60)."""
    return F.conv(F.substring(digest, 1, POSITION_DIGITS), 16, 10).cast("bigint")


def position_prefix(value: int) -> str | None:
    """Smallest digest prefix at or above a position; None past the last one."""
    return None if value >= POSITIONS else format(value, f"0{POSITION_DIGITS}x")
