"""From conversations or preference pairs to training text."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chat import answer_pieces, assistant_spans, invalid_messages, render_chat
from ..functions.encoders import OffsetTokenizer
from ..functions.tokens import token_mask, truncate_tokens
from ..operators.packing import pack, pack_blocks
from ..operators.whole_rows import pack_whole, whole_blocks
from ..sources.contracts import TASK_COLUMNS, task_columns

# The maximum lengths in tokens that the recipes use. Nothing is cut unless asked for.
MAX_LENGTH = {"sft": 4096, "preference": 2048}


@dataclass(frozen=True)
class TrainingText:
    """Rendered rows, and the rows that cannot be rendered."""

    rows: DataFrame
    rejects: DataFrame


def split_invalid(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rows with a message that lacks the content it would print."""
    bad: Column = F.lit(False)
    for name in columns:
        bad = bad | F.col(name).isNull() | invalid_messages(F.col(name))
    return df.where(~bad), df.where(bad)


def render_pairs(df: DataFrame, eos: str) -> DataFrame:
    """Add ``chosen_text`` and ``rejected_text``."""
    return df.withColumns(
        {
            "chosen_text": render_chat(F.col("chosen"), eos),
            "rejected_text": render_chat(F.col("rejected"), eos),
        }
    )


def sft_text(
    df: DataFrame,
    *,
    eos: str,
    keep: Sequence[str] = (),
    masked: bool = False,
    max_length: int | None = None,
    add_generation_prompt: bool = False,
    on_invalid: str = "reject",
    tokenizer: Callable[[Column], Column] | None = None,
) -> TrainingText:
    """Text, tokens and truncation flag per conversation; if ``masked``, loss spans in
    the text and ``mask``, one flag for each token that is kept.

    ``max_length=None`` cuts nothing, as packing needs it. ``tokenizer`` (``token_lister``, ``OffsetTokenizer``)
    gives ids of a real tokenizer; masks of these need one that knows offsets, ``OffsetTokenizer``.
    Row-local throughout: no shuffle. ``on_invalid="raise"`` fails the job at the
    first conversation that cannot be rendered instead of setting it aside.
    """
    offsets = isinstance(tokenizer, OffsetTokenizer)
    if masked and tokenizer is not None and not offsets:
        raise ValueError("masks need the built-in tokens or a tokenizer with offsets")
    valid, rejects = _guarded(task_columns(df, "sft", tuple(keep)), "sft", on_invalid)
    rendered = valid.withColumn(
        "text", render_chat(F.col("messages"), eos, add_generation_prompt)
    )
    if masked:
        rendered = rendered.withColumn("spans", assistant_spans(F.col("messages"), eos))
        if offsets:
            # Ids and mask come from one call; what follows only takes them apart.
            found = tokenizer.masked(F.col("text"), answer_pieces(F.col("messages"), eos))
            rendered = rendered.withColumn("_found", found).withColumn("mask", F.col("_found.mask"))
            tokenizer = lambda _: F.col("_found.ids")
        else:
            rendered = rendered.withColumn("mask", token_mask(F.col("messages"), eos, add_generation_prompt))
    mask = "mask" if masked else None
    cut = truncate_tokens(rendered, max_length, eos=eos, tokenizer=tokenizer, mask=mask)
    return TrainingText(cut.drop("messages", "_found"), rejects)


def preference_text(
    df: DataFrame,
    *,
    eos: str,
    keep: Sequence[str] = (),
    max_length: int | None = None,
    on_invalid: str = "reject",
    tokenizer: Callable[[Column], Column] | None = None,
) -> TrainingText:
    """Both sides of each pair as text and tokens; any ``messages`` column is left out.

    ``max_length=None`` cuts nothing.
    """
    valid, rejects = _guarded(task_columns(df, "preference", tuple(keep)), "preference", on_invalid)
    rendered = render_pairs(valid, eos).drop("chosen", "rejected")
    for side in ("chosen", "rejected"):
        rendered = truncate_tokens(rendered, max_length, eos=eos, text=f"{side}_text", tokenizer=tokenizer)
        for name in ("tokens", "n_tokens", "truncated"):
            rendered = rendered.withColumnRenamed(name, f"{side}_{name}")
    return TrainingText(rendered, rejects)


def packed_text(
    text: TrainingText,
    key_cols: Sequence[str],
    *,
    block: int,
    shards: int = 1,
    seed: int = 0,
    whole_rows: bool = False,
) -> DataFrame:
    """Token blocks from rendered rows, with ``mask`` if they have one.

    By default each of ``shards`` is one stream that is cut into blocks of fixed length. With ``whole_rows`` no row of up to
    ``block`` tokens is cut (``pack_whole``): blocks may be short, and ``lengths`` says where rows begin.
    Takes the tokens as they are: render with ``max_length=None`` to lose none.
    """
    masked = "mask" in text.rows.columns
    packed = F.arrays_zip("tokens", "mask") if masked else F.col("tokens")
    rows = text.rows.select(*key_cols, packed.alias("tokens"), F.size("tokens").alias("length"))
    if whole_rows:
        blocks = whole_blocks(pack_whole(rows, key_cols, "length", block=block, seed=seed, materialise=True), "tokens")
    else:
        placed = pack(rows, key_cols, "length", block=block, shards=shards, seed=seed, materialise=True)
        blocks = pack_blocks(placed, "tokens", block=block)
    if not masked:
        return blocks
    others = [c for c in blocks.columns if c != "tokens"]
    return blocks.select(*others, F.col("tokens.tokens").alias("tokens"), F.col("tokens.mask").alias("mask"))


def _guarded(df: DataFrame, task: str, on_invalid: str) -> tuple[DataFrame, DataFrame]:
    columns = TASK_COLUMNS[task]
    if on_invalid == "reject":
        return split_invalid(df, columns)
    if on_invalid != "raise":
        raise ValueError(f"on_invalid must be 'reject' or 'raise', got {on_invalid!r}")
    failure = F.raise_error(F.lit(f"{task} data holds a message without content"))
    for name in columns:
        bad = F.col(name).isNull() | invalid_messages(F.col(name))
        df = df.withColumn(
            name, F.when(bad, failure.cast(df.schema[name].dataType)).otherwise(F.col(name))
        )
    return df, df.where(F.lit(False))
