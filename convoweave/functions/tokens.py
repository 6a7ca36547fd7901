"""Token counting and truncation with special tokens kept whole.

A trained vocabulary is not part of this library. The built-in counter splits
at white space and takes role markers and the end-of-sequence token as atoms;
``token_counter`` plugs in a real tokenizer.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chat import ROLE_MARKERS, invalid_messages, render_piece


def token_pattern(eos: str, special_tokens: Sequence[str] = tuple(ROLE_MARKERS.values())) -> str:
    """Special tokens, longest first, and words that do not run into one.

    A plain ``\\S+`` would swallow a marker glued to a word. Where all special
    tokens open with ``<``, words stop there and are tried first for speed.
    """
    special = sorted({*special_tokens, eos}, key=lambda token: (-len(token), token))
    atoms = "|".join(re.escape(token) for token in special)
    if all(token.startswith("<") for token in special):
        return rf"[^\s<]++|{atoms}|<"
    return rf"{atoms}|(?:(?!{atoms})\S)+"


def tokenize(text: Column, eos: str, **kwargs) -> Column:
    return F.regexp_extract_all(text, F.lit(token_pattern(eos, **kwargs)), F.lit(0))


def token_count(text: Column, eos: str, **kwargs) -> Column:
    return F.size(tokenize(text, eos, **kwargs))


def token_mask(messages: Column, eos: str, add_generation_prompt: bool = False, **kwargs) -> Column:
    """One flag per token of the rendered conversation: true for what an assistant says.

    Markers are atoms and every piece ends at white space or the end-of-sequence token, so the tokens
    of the text are those of its pieces; of an assistant's, only the marker is not trained on.
    """
    piece = lambda m: render_piece(m["role"], m["content"], F.lit(False), eos)
    flags = F.flatten(
        F.transform(
            messages,
            lambda m: F.transform(
                tokenize(piece(m), eos, **kwargs),
                lambda _, i: (i > 0) & F.coalesce(m["role"] == "assistant", F.lit(False)),
            ),
        )
    )
    if add_generation_prompt:
        flags = F.when(F.size(messages) > 0, F.array_append(flags, F.lit(False))).otherwise(flags)
    return F.when(~invalid_messages(messages), flags)


def token_lister(tokenize_batch: Callable[[list[str]], Sequence[Sequence[int]]]) -> Callable[[Column], Column]:
    """Column function from a tokenizer's batch encoder: ids of each text, run on Arrow batches."""

    @F.pandas_udf("array<int>")
    def tokens(texts: pd.Series) -> pd.Series:
        found = iter(tokenize_batch(texts.dropna().tolist()))
        return pd.Series([list(next(found)) if known else None for known in texts.notna()], dtype=object)

    return tokens


def token_counter(count_batch: Callable[[list[str]], Sequence[int]]) -> Callable[[Column], Column]:
    """Column function from a tokenizer's batch counter, run on Arrow batches."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        counts = iter(count_batch(texts.dropna().tolist()))
        return pd.Series(
            [next(counts) if known else None for known in texts.notna()], dtype="Int32"
        )

    return count


def truncate_tokens(
    df: DataFrame,
    max_length: int | None,
    *,
    eos: str,
    text: str = "text",
    tokenizer: Callable[[Column], Column] | None = None,
    mask: str | None = None,
    **kwargs,
) -> DataFrame:
    """Keep the first ``max_length`` tokens, or all if it is None; add ``tokens``,
    ``n_tokens`` (before the cut) and ``truncated``.

    ``tokenizer`` (``token_lister``) gives ids instead of words. ``mask`` names a column with one flag
    per token, which is cut alike.
    """
    if max_length is not None and max_length < 1:
        raise ValueError(f"max_length must be positive, got {max_length}")
    tokens = tokenize(F.col(text), eos, **kwargs) if tokenizer is None else tokenizer(F.col(text))
    out = df.withColumn("tokens", tokens).withColumn("n_tokens", F.size("tokens"))
    if max_length is None:
        return out.withColumn("truncated", F.lit(False))
    out = out.withColumn("truncated", F.col("n_tokens") > max_length)
    for name in ("tokens", mask) if mask else ("tokens",):
        out = out.withColumn(name, F.slice(name, 1, max_length))
    return out
