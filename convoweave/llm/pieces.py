"""The pieces of a SentencePiece model file, and the words they are laid over."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

SPACE = "▁"  # stands for a space inside pieces

# A word is a run of spaces with what follows it up to the next space or line end;
# line ends are words of their own.
_WORDS = re.compile(rb"\n+| *[^ \n]+| +")


@dataclass(frozen=True)
class Pieces:
    """Scores are log weights of a unigram model: the best segmentation has the largest sum.

    A character without a piece of its own becomes its UTF-8 bytes and scores ``unknown``.
    """

    scores: dict[str, float]
    ids: dict[str, int]
    byte_ids: tuple[int, ...]
    texts: tuple[bytes, ...]  # by id: what decoding appends
    longest: int
    unknown: float


@lru_cache(maxsize=4)
def load_pieces(path: str) -> Pieces:
    """Read a model file. Needs byte pieces, an identity normalizer and a leading space.

    Refuses models whose pieces reach over words, as the words are segmented one by one.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    scores: dict[str, float] = {}
    ids: dict[str, int] = {}
    byte_ids = [-1] * 256
    texts = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
            texts.append(bytes([int(piece[1:-1], 16)]))
        elif model.is_unknown(i) or model.is_control(i):
            texts.append(b"")
        else:
            if not model.is_unused(i):
                scores[piece], ids[piece] = model.get_score(i), i
            texts.append(piece.replace(SPACE, " ").encode())
    if min(byte_ids) < 0:
        raise ValueError("the model has no byte pieces")
    if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in scores):
        raise ValueError("the model has pieces that reach over words")
    longest = max(map(len, scores))
    return Pieces(scores, ids, tuple(byte_ids), tuple(texts), longest, min(scores.values()) - 10)


def piece_words(raw: bytes | None) -> list[bytes]:
    """Words of a text, in order; joined they are the text with a space in front."""
    return _WORDS.findall(b" " + raw) if raw else []


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    """``(piece, id, score)`` of the vocabulary."""
    rows = [(p, pieces.ids[p], float(s)) for p, s in pieces.scores.items()]
    return spark.createDataFrame(rows, "piece string, id int, score double")


def best_path(word: str, pieces: Pieces) -> list[int]:
    """Ids of the best segmentation of one word; ties go to the longest last piece."""
    n, scores = len(word), pieces.scores
    best, back = [0.0] + [0.0] * n, [0] * (n + 1)
    for end in range(1, n + 1):
        top, start_of = float("-inf"), end - 1
        for start in range(max(0, end - pieces.longest), end):
            score = scores.get(word[start:end])
            if score is None and start == end - 1:
                score = pieces.unknown
            if score is not None and best[start] + score > top:
                top, start_of = best[start] + score, start
        best[end], back[end] = top, start_of
    out: list[int] = []
    end = n
    while end:
        part = word[back[end] : end]
        found = pieces.ids.get(part)
        out += [found] if found is not None else [pieces.byte_ids[b] for b in reversed(part.encode())]
        end = back[end]
    return out[::-1]
