"""Between one row per turn and one row per conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chat import ROLE_MARKERS, answer_bounds, piece_length, render_piece
from .running import running_start
from .skew import salted_join

# Turns of one conversation that are summed together in one task.
_TURN_BITS = 12
# Tasks that share the turns of one conversation in a join.
_TURN_SALTS = 16


def assemble_messages(
    turns: DataFrame, *, key: str, turn: str = "turn", role: str = "role", content: str = "content"
) -> DataFrame:
    """``(key, messages)`` from one row per turn, in turn order.

    A conversation is one sample and thus has to fit in one row. Where that is
    not so, ``render_turns`` and ``turn_spans`` work on the turns themselves.
    """
    if turns.isStreaming:
        raise ValueError("assembling messages groups turns and works on batch data only")
    message = F.struct(
        F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(content).alias("content")
    )
    return turns.groupBy(key).agg(
        F.transform(
            F.array_sort(F.collect_list(message)),
            lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")),
        ).alias("messages")
    )


def split_invalid_turns(
    turns: DataFrame, *, key: str, turn: str = "turn", role: str = "role", content: str = "content"
) -> tuple[DataFrame, DataFrame]:
    """Turns of valid conversations, and all turns of those that cannot be rendered."""
    bad = (
        turns.where(F.col(content).isNull() & F.col(role).isin(*ROLE_MARKERS))
        .select(key)
        .distinct()
    )
    return tuple(
        salted_join(turns, bad, [key], how, spread_by=F.col(turn), salts=_TURN_SALTS)
        for how in ("left_anti", "left_semi")
    )


def render_turns(
    turns: DataFrame,
    *,
    eos: str,
    key: str,
    turn: str = "turn",
    role: str = "role",
    content: str = "content",
    turn_bits: int = _TURN_BITS,
) -> DataFrame:
    """Training text as one row per turn: ``(key, turn, piece, start)``.

    For conversations too long for one row: the pieces in turn order are the
    text, ``start`` is the code point at which each begins, and no conversation
    is gathered. Set invalid turns aside first. ``turn`` must be an integer unique in its conversation.
    """
    if turns.isStreaming:
        raise ValueError("the last turn is known for batch data only")
    final = turns.groupBy(key).agg(F.max(turn).alias(turn)).withColumn("_last", F.lit(True))
    # Joined on key and turn, so that a long conversation is spread by its turns.
    marked = turns.select(key, turn, role, content).join(final, [key, turn], "left")
    length = piece_length(F.col(role), F.col(content), eos).cast("bigint")
    placed = running_start(
        marked.withColumn("_length", length),
        group=[key],
        stretch=F.shiftright(F.col(turn), turn_bits),
        order=[turn],
        value="_length",
        out="start",
    )
    return placed.select(
        key,
        turn,
        render_piece(F.col(role), F.col(content), F.col("_last").isNotNull(), eos).alias("piece"),
        F.col("start").cast("bigint").alias("start"),
    )


def turn_spans(
    turns: DataFrame,
    *,
    eos: str,
    key: str,
    turn: str = "turn",
    role: str = "role",
    content: str = "content",
    turn_bits: int = _TURN_BITS,
) -> DataFrame:
    """Loss spans straight from turns: ``(key, turn, start, end)`` per answer.

    Only lengths move; the text stays at its scan. Set invalid turns aside first.
    ``turn`` must be an integer unique in its conversation. Long conversations
    are summed in stretches.
    """
    if turns.isStreaming:
        raise ValueError("spans of turns need running offsets and work on batch data only")
    first, last = answer_bounds(F.lit(0), F.col(content), eos)
    lengths = turns.select(
        key,
        turn,
        piece_length(F.col(role), F.col(content), eos).cast("bigint").alias("_length"),
        F.when(F.col(role) == "assistant", first).alias("_first"),
        F.when(F.col(role) == "assistant", last).alias("_last"),
    )
    placed = running_start(
        lengths,
        group=[key],
        stretch=F.shiftright(F.col(turn), turn_bits),
        order=[turn],
        value="_length",
        out="_at",
    )
    return placed.where(F.col("_first").isNotNull()).select(
        key,
        turn,
        (F.col("_at") + F.col("_first")).cast("bigint").alias("start"),
        (F.col("_at") + F.col("_last")).cast("bigint").alias("end"),
    )
