"""Token counts of texts under a unigram piece model, by a trie of their words.

The distinct words of a slice of documents, sorted, are a trie in depth-first
order: what a word shares with the one before it is a prefix whose forward
scores (best sum of piece scores up to each character, and the number of tokens of
that segmentation) are still on the stack. Each node is computed once, and a word's
count is the number stored at its end. A text has the sum over its words.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField

from .batches import Recent, append_columns, raw_texts
from .pieces import SPACE, Pieces, load_pieces, piece_words

# Words a worker remembers with their counts, and the longest of them in bytes.
KNOWN_WORDS = 300_000
KNOWN_BYTES = 64

_RECENT: dict[str, Recent] = {}


def terminal_counts(words: Iterable[str], pieces: Pieces) -> list[int]:
    """Token counts of sorted distinct words."""
    get, longest, unknown = pieces.scores.get, pieces.longest, pieces.unknown
    best, count, before, out = [0.0], [0], "", []
    for word in words:
        shared = 0
        for a, b in zip(before, word):
            if a != b:
                break
            shared += 1
        del best[shared + 1 :], count[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            top, tokens = float("-inf"), 0
            for start in range(max(0, end - longest), end):
                score = get(word[start:end])
                if score is not None and best[start] + score > top:
                    top, tokens = best[start] + score, count[start] + 1
            if get(word[end - 1]) is None and best[end - 1] + unknown > top:
                top, tokens = best[end - 1] + unknown, count[end - 1] + len(word[end - 1].encode())
            best.append(top)
            count.append(tokens)
        out.append(count[-1])
        before = word
    return out


def count_tokens(
    docs: DataFrame, model: str, *, text_col: str = "text", out: str = "n_tokens", keep: list[str] | None = None
) -> DataFrame:
    """Documents plus ``out``, the number of tokens of each whole text.

    A null or empty text has none. Nothing is shuffled; a worker holds one slice of texts,
    the distinct words of it and a bounded table of words it has seen. A very long word
    takes memory in proportion to its length. A column named ``out`` is replaced.
    """

    def make(words: list[bytes]) -> list[int]:
        texts = {w.decode("utf-8", "replace").replace(" ", SPACE): w for w in words}
        order = sorted(texts)
        counts = dict(zip(order, terminal_counts(order, load_pieces(model))))
        found = {texts[t]: n for t, n in counts.items()}
        return [found[w] for w in words]

    def count(batch: pa.RecordBatch) -> list[list[int]]:
        recent = _RECENT.setdefault(model, Recent(KNOWN_WORDS))
        words = [piece_words(raw) for raw in raw_texts(batch.column(0).cast(pa.string()))]
        flat = list(chain.from_iterable(words))
        counts = iter(recent.lookup(flat, make, KNOWN_BYTES))
        return [[sum(islice(counts, len(w))) for w in words]]

    return append_columns(docs, [text_col], [StructField(out, LongType())], count, text=text_col, keep=keep)
