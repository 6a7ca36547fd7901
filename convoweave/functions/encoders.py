"""Trained tokenizers as column functions: ids, counts, and loss masks from token offsets.

An encoder is any picklable object whose ``encode(texts)`` gives ``(ids, starts, ends)`` for each text: the ids and,
for each token, its range of code points in that text, in order. ``FileTokenizer`` is one over a
tokenizer file. Everything runs on Arrow batches next to the text; nothing is shuffled.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F

MASKED = "struct<ids:array<int>,mask:array<boolean>>"

# Texts encoded in one call: up to so many, or so many characters if that is less. Answers are Python objects of a hundred
# bytes a token; they are turned into Arrow before the next call, so a worker holds those of one call only.
_AT_ONCE = 64
_CHARACTERS_AT_ONCE = 1 << 18
_IDS_AT_ONCE = 1 << 16


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> Sequence[tuple[Sequence[int], Sequence[int], Sequence[int]]]: ...


@lru_cache(maxsize=4)
def _tokenizer(path: str, special_tokens: tuple[str, ...]):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    if special_tokens:
        loaded.add_special_tokens(list(special_tokens))
    return loaded


@dataclass(frozen=True)
class FileTokenizer:
    """A tokenizer file that every worker can read, loaded once by each of them.

    ``special_tokens`` (role markers, the end-of-sequence token) are atoms wherever they stand; those
    the file does not know get the next free ids, in the order given.
    """

    path: str
    special_tokens: tuple[str, ...] = ()

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int], list[int]]]:
        found = _tokenizer(self.path, self.special_tokens).encode_batch(texts, add_special_tokens=False)
        return [(e.ids, [a for a, _ in e.offsets], [b for _, b in e.offsets]) for e in found]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return _tokenizer(self.path, self.special_tokens).decode_batch(ids, skip_special_tokens=False)


def span_mask(
    starts: np.ndarray, ends: np.ndarray, spans: Sequence[tuple[int, int]], straddling: bool = True
) -> np.ndarray:
    """One flag per token: whether it belongs to one of the sorted spans.

    A span takes all tokens from the one that holds its first code point to the one that holds its last, so a
    token that straddles a border counts as inside. With ``straddling=False`` a token must lie inside.
    Tokens of no width (trimmed white space) belong to what surrounds them.
    """
    steps = np.zeros(len(starts) + 1, np.int64)
    if len(spans):
        lo, hi = np.asarray(spans, np.int64).reshape(-1, 2).T
        some = hi > lo
        lo, hi = lo[some], hi[some]
        if straddling:
            first, last = np.searchsorted(ends, lo, "right"), np.searchsorted(starts, hi, "left")
        else:
            first, last = np.searchsorted(starts, lo, "left"), np.searchsorted(ends, hi, "right")
        last = np.maximum(first, last)
        np.add.at(steps, first, 1)
        np.add.at(steps, last, -1)
    return np.cumsum(steps[:-1]) > 0


@dataclass(frozen=True)
class OffsetTokenizer:
    """Column functions of an encoder. Called with a text column, it gives the ids."""

    encoder: Encoder
    straddling: bool = True

    def __call__(self, text: Column) -> Column:
        encoder = self.encoder

        @F.arrow_udf("array<int>")
        def ids(texts: pa.Array) -> pa.Array:
            parts = [
                _lists([None if r is None else r[0] for r in rows], pa.int32()) for rows in _encoded(encoder, texts)
            ]
            return pa.concat_arrays(parts or [pa.array([], pa.list_(pa.int32()))])

        return ids(text)

    def masked(self, text: Column, pieces: Column) -> Column:
        """Struct of ``ids`` and ``mask``; null for a null text.

        ``pieces`` (``answer_pieces``) are the lengths of consecutive parts of the text, and the trainable stretch inside each.
        """
        encoder, straddling = self.encoder, self.straddling

        @F.arrow_udf(MASKED)
        def tokens(texts: pa.Array, pieces: pa.Array) -> pa.Array:
            found, masks, spans = [], [], _spans(pieces)
            for rows in _encoded(encoder, texts):
                found.append(_lists([None if r is None else r[0] for r in rows], pa.int32()))
                masks.append(_lists([
                    None if r is None else span_mask(*map(np.asarray, r[1:]), s, straddling) for r, s in zip(rows, spans)
                ], pa.bool_()))
            if not found:
                return pa.array([], pa.struct([("ids", pa.list_(pa.int32())), ("mask", pa.list_(pa.bool_()))]))
            return pa.StructArray.from_arrays(
                [pa.concat_arrays(found), pa.concat_arrays(masks)], ["ids", "mask"], mask=texts.is_null()
            )

        return tokens(text, pieces)


def _spans(pieces: pa.Array):
    """For each row the trainable stretches in code points of the text."""
    for row in pieces:
        held = row.values
        if held is None or not len(held):
            yield ()
            continue
        length, start, end = (
            pa.compute.fill_null(held.field(c), -1).to_numpy(zero_copy_only=False) for c in ("length", "start", "end")
        )
        at = np.cumsum(length) - length
        speaks = start >= 0
        yield np.stack([(at + start)[speaks], (at + end)[speaks]], axis=1)


def _calls(sizes: Sequence[int], rows: int, total: int):
    """``(from, to)`` of consecutive rows, up to ``rows`` of them and no more than ``total`` unless one alone has more."""
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and (i - start == rows or held + size > total):
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def _encoded(encoder: Encoder, texts: pa.Array):
    """Call by call the answers to its texts, None for a null one."""
    sizes = pa.compute.fill_null(pa.compute.utf8_length(texts), 0).to_pylist()
    for start, end in _calls(sizes, _AT_ONCE, _CHARACTERS_AT_ONCE):
        part = texts.slice(start, end - start).to_pylist()
        answers = iter(encoder.encode([t for t in part if t is not None]))
        yield [None if t is None else next(answers) for t in part]


def _lists(rows: list, type_: pa.DataType) -> pa.Array:
    return pa.array([None if r is None else np.asarray(r, type_.to_pandas_dtype()) for r in rows], pa.list_(type_))


def token_decoder(decode: Callable[[list[list[int]]], list[str]]) -> Callable[[Column], Column]:
    """Column function from lists of ids to their text."""

    @F.arrow_udf("string")
    def texts(ids: pa.Array) -> pa.Array:
        sizes = pa.compute.fill_null(pa.compute.list_value_length(ids), 0).to_pylist()
        parts = []
        for start, end in _calls(sizes, len(sizes), _IDS_AT_ONCE):
            rows = ids.slice(start, end - start).to_pylist()
            answers = iter(decode([x for x in rows if x is not None]))
            parts.append(pa.array([None if x is None else next(answers) for x in rows], pa.string()))
        return pa.concat_arrays(parts or [pa.array([], pa.string())])

    return texts
