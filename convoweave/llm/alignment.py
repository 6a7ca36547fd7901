"""Alignment of the tokens that two tokenizers make of the same texts.

One side is a byte-level BPE of the tokenizers library, the other a SentencePiece model. Both cut the
same bytes, a space and the text, so a token is a stretch of bytes on either side. ``pandas.merge_asof``, keyed by
document, finds for each token start the token of the other side that covers it; both
directions together are all overlaps. Where a token of either side ends, a group ends.

Texts are aligned in blocks of a few megabytes. A block keeps its distinct pairs of overlapping ids
once, and for each document which of them it holds how often, so that a corpus-wide count of pairs
costs one row for each pair and block, and the answers go back to blocks, not to tokens.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.scratch import cut_lineage
from .batches import Recent, raw_texts, slices

# White space with what follows it. Neither tokenizer has tokens that reach from a word into the next chunk.
_CHUNKS = re.compile(r"\s*\S+|\s+")

# Chunks whose tokens a worker remembers, and the longest of them in characters.
KNOWN_CHUNKS = 150_000
KNOWN_CHARS = 48

# Text bytes that are aligned at once.
BLOCK_BYTES = 2 << 20

_FOUND = """
    n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string,
    _block bigint, _pair array<int>, _times array<int>, _a array<int>, _b array<int>, _m array<bigint>
"""
_COUNTED = """
    n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint
"""


def _byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level entries: printable ones for themselves, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class TokenPair:
    """Both tokenizers, with the bytes of their entries."""

    def __init__(self, byte_level: str, pieces: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=pieces)
        self.recent = Recent(KNOWN_CHUNKS)
        alphabet = _byte_alphabet()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for entry, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(alphabet[c] for c in entry) if set(entry) <= alphabet.keys() else entry.encode()
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(
                bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
            )
        self.a_length = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_length = np.array([len(x) for x in self.b_bytes], np.int64)
        self.a_names = [np.array([f"{i}{end}" for i in range(len(self.a_bytes))], object) for end in ",|"]
        self.b_names = [np.array([f"{i}{end}" for i in range(len(self.b_bytes))], object) for end in ",;"]
        self._check_pieces()

    def _check_pieces(self) -> None:
        """Find out where texts may be cut without changing their tokens."""
        reach, marked = set(), False
        for i in range(self.b.get_piece_size()):
            if self.b.is_byte(i) or self.b.is_unknown(i) or self.b.is_control(i):
                continue
            piece = self.b.id_to_piece(i).replace("▁", " ")
            reach.update(y for x, y in zip(piece, piece[1:]) if not x.isspace() and y.isspace())
            marked = marked or any(x.isalpha() and y in ",." for x, y in zip(piece, piece[1:]))
        # Nothing is glued to a line end, so what follows one is encoded as inside a text, without a space before it.
        start = self.b.encode("\n")
        self.start = start if len(start) == 2 and self.b.encode("\n\n") == [*start, start[1]] else None
        if " " in reach or "\n" in reach:
            self.start = None
        self.marks = {} if marked or self.start is None else {m: self._each([m])[0] for m in ",."}
        # Separators that only one side takes for white space, and white space inside pieces.
        odd = "".join(map(re.escape, sorted(reach | set("\x1c\x1d\x1e\x1f\x85"))))
        self.odd = re.compile(f"[{odd}]")

    def _each(self, chunks: list[str]) -> list[tuple[bytes, bytes, bool]]:
        """Tokens of chunks as they are inside a text, and whether both sides give its bytes."""
        a = [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        b = [x[2:] for x in self.b.encode(["\n" + c for c in chunks], num_threads=1)]
        return [(_packed(x), _packed(y), self._same(c.encode(), x, y)) for c, x, y in zip(chunks, a, b)]

    def _joined(self, chunks: list[str]) -> list[tuple[bytes, bytes, bool]]:
        """The same for chunks that are cut off each other where they are joined, in one go."""
        text = "".join(chunks)
        raw = text.encode()
        sizes = map(len, chunks) if len(raw) == len(text) else (len(c.encode()) for c in chunks)
        ends = np.cumsum(np.fromiter(sizes, np.int64, len(chunks)))
        sides = []
        for ids, length, entries in (
            (self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.a_length, self.a_bytes),
            (self.b.encode("\n" + text)[2:], self.b_length, self.b_bytes),
        ):
            token_ends = np.cumsum(length[ids])
            at = np.searchsorted(token_ends, ends) + 1
            if b"".join(map(entries.__getitem__, ids)) != raw or (token_ends[at - 1] != ends).any():
                return self._each(chunks)
            packed, cuts = _packed(ids), (4 * at).tolist()
            sides.append([packed[x:y] for x, y in zip([0, *cuts], cuts)])
        return [(x, y, True) for x, y in zip(*sides)]

    def _same(self, raw: bytes, a, b) -> bool:
        return raw == b"".join([self.a_bytes[i] for i in a]) and raw == b"".join([self.b_bytes[i] for i in b])

    def chunks(self, chunks: list[str]) -> list[tuple[bytes, bytes, bool]]:
        # A word and a comma or full stop are cut between them by both sides.
        stems = {c: c[:-1] for c in chunks if c[-1] in self.marks and c[1:-1].isalpha() and c[0] == " "}
        plain = list({stems.get(c, c) for c in chunks})
        # A chunk that opens with a space and ends without one leaves its neighbours as they are.
        alone = [c for c in plain if c[0] != " " or c[-1].isspace()]
        others = [c for c in plain if not (c[0] != " " or c[-1].isspace())]
        known = dict(zip(alone, self._each(alone))) if alone else {}
        for i in range(0, len(others), 2048):
            known.update(zip(others[i : i + 2048], self._joined(others[i : i + 2048])))
        for c, stem in stems.items():
            word, mark = known[stem], self.marks[c[-1]]
            known[c] = (word[0] + mark[0], word[1] + mark[1], word[2] and mark[2])
        return [known[c] for c in chunks]

    def whole(self, text: str) -> tuple[bytes, bytes]:
        """Tokens of a text that is encoded in one go."""
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        return (_packed(a), _packed(b)) if self._same(b" " + text.encode(), a, b) else (b"", b"")

    def encode(self, texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For both sides the ids of all texts, and how many each text has; none where the bytes differ."""
        found: dict[int, tuple[bytes, bytes]] = {}
        flat: list[str] = []
        at, held = [], []
        for k, raw in enumerate(texts):
            if not raw:
                continue
            text = raw.decode("utf-8", "replace")
            if "\ufffd" in text and text.encode() != raw:
                continue  # not UTF-8
            if self.start is None or self.odd.search(text):
                found[k] = self.whole(text)
            else:
                mine = _CHUNKS.findall(" " + text)
                flat += mine
                at.append(k)
                held.append(len(mine))
        words = pa.array(flat, pa.string()).dictionary_encode()
        distinct = self.recent.lookup(words.dictionary.to_pylist(), self.chunks, KNOWN_CHARS)
        codes = words.indices
        bad = np.array([not x[2] for x in distinct], bool)[codes.to_numpy()]
        cuts = np.concatenate([[0], np.cumsum(held, dtype=np.int64)])
        for i in np.unique(np.searchsorted(cuts, np.flatnonzero(bad), "right") - 1).tolist():
            # Whether the bytes agree is a matter of the whole text.
            found[at[i]] = self.whole(texts[at[i]].decode())
        return [self._gather([x[side] for x in distinct], codes, cuts, at, found, side, len(texts)) for side in (0, 1)]

    def _gather(self, values: list[bytes], codes, cuts, at, found, side: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        lists = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(values), np.int32)))
        taken = lists.take(codes)
        ids, ends = taken.flatten().to_numpy(), taken.offsets.to_numpy().astype(np.int64)
        ends = (ends - ends[0])[cuts]
        counts = np.zeros(n, np.int64)
        counts[at] = np.diff(ends)
        if not found:
            return ids.astype(np.int64), counts
        parts = {k: ids[x:y] for k, x, y in zip(at, ends[:-1].tolist(), ends[1:].tolist())}
        parts.update((k, np.frombuffer(v[side], np.int32)) for k, v in found.items())
        for k in found:
            counts[k] = len(parts[k])
        return np.concatenate([parts[k] for k in sorted(parts)]).astype(np.int64), counts


def _packed(ids) -> bytes:
    return array("i", ids).tobytes()


@lru_cache(maxsize=2)
def token_pair(byte_level: str, pieces: str) -> TokenPair:
    return TokenPair(byte_level, pieces)


def _side(ids: np.ndarray, counts: np.ndarray, length: np.ndarray) -> pd.DataFrame:
    """One row per token: document, id, first byte and end, counted through all texts that have tokens."""
    end = np.cumsum(length[ids])
    return pd.DataFrame({"at": end - length[ids], "doc": np.repeat(np.arange(len(counts)), counts), "id": ids, "end": end})


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """``(doc, id_a, id_b)``, one row for each pair of tokens whose byte ranges overlap."""
    a, b = a[["at", "doc", "id"]], b[["at", "doc", "id"]]
    covering = pd.merge_asof(a, b, on="at", by="doc", suffixes=("_a", "_b"))
    other = pd.merge_asof(b, a.assign(first=a["at"]), on="at", by="doc", suffixes=("_b", "_a"))
    # Tokens that start together have met in the first direction.
    other = other[other["at"] != other["first"]]
    return pd.concat([covering[["doc", "id_a", "id_b"]], other[["doc", "id_a", "id_b"]]], ignore_index=True)


def align_texts(pair: TokenPair, texts: list[bytes | None]):
    """Columns of ``_FOUND`` up to the digest; ids and counts of the distinct pairs; and which of them
    the texts hold how often, cut at ``cuts``."""
    n = len(texts)
    (ids_a, sizes_a), (ids_b, sizes_b) = pair.encode(texts)
    a, b = _side(ids_a, sizes_a, pair.a_length), _side(ids_b, sizes_b, pair.b_length)
    links = overlaps(a, b)
    doc = links["doc"].to_numpy()
    code, codes = pd.factorize((links["id_a"].to_numpy() << 32) | links["id_b"].to_numpy())
    mine, held = pd.factorize(doc * max(len(codes), 1) + code)
    times = np.bincount(mine, minlength=len(held))
    order = np.argsort(held)
    held, times = held[order], times[order]
    cuts = np.searchsorted(held, np.arange(n + 1) * max(len(codes), 1))
    numbers = held % max(len(codes), 1)

    # Groups end where tokens of both sides end; inside a group come the ids of A, then those of B.
    a_end, b_end = a["end"].to_numpy(), b["end"].to_numpy()
    a_last, b_last = np.isin(a_end, b_end, assume_unique=True), np.isin(b_end, a_end, assume_unique=True)
    a_group = np.cumsum(a_last) - a_last
    b_group = np.cumsum(b_last) - b_last
    in_a, in_b = np.bincount(a_group), np.bincount(b_group)
    place_a = np.arange(len(a)) + (np.cumsum(in_b) - in_b)[a_group]
    place_b = np.arange(len(b)) + np.cumsum(in_a)[b_group]
    names = np.empty(len(a) + len(b), object)
    names[place_a] = np.where(a_last, pair.a_names[1][ids_a], pair.a_names[0][ids_a])
    names[place_b] = np.where(b_last, pair.b_names[1][ids_b], pair.b_names[0][ids_b])
    groups = np.bincount(a["doc"].to_numpy()[a_last], minlength=n)
    ends = np.concatenate([[0], np.cumsum(sizes_a + sizes_b)])
    listed = names.tolist()
    digests = [
        hashlib.sha256("".join(listed[x:y])[:-1].encode()).hexdigest() if y > x else ""
        for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())
    ]
    columns = [sizes_a, sizes_b, groups, np.bincount(doc, minlength=n), digests]
    total = np.bincount(code, minlength=len(codes))
    return columns, (codes >> 32, codes & 0xFFFFFFFF, total), (numbers, times), cuts


def align_corpus(
    docs: DataFrame, byte_level: str, pieces: str, *, text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """``keep`` (all columns but the text by default) with counts of tokens, groups and links of each text.

    ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256`` describe a text by itself. ``count_sum``
    adds up, over its links, how many links of the whole corpus join the same two ids; ``n_best`` counts the links
    whose count is the highest of all pairs with their B id. Null and empty texts, and texts whose bytes either side
    does not give back, have zeros and an empty digest. Rows keep their number, equal rows too; columns with the new
    names are replaced. Texts are read once and never shuffled; what is written are the
    pairs of each block and the pair numbers of each text.
    """
    new = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    given = [c for c in docs.columns if (c != text_col if keep is None else c in keep) and c not in new]
    names = [f"_c{i}" for i in range(len(given))]
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    rows = docs.select(*[quoted(c).alias(x) for c, x in zip(given, names)], quoted(text_col).cast("string").alias("_text"))
    found = StructType.fromDDL(_FOUND)
    schema = StructType([*[rows.schema[x] for x in names], *found.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = token_pair(byte_level, pieces)
        block = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in slices(whole, "_text", BLOCK_BYTES):
                columns, pairs, held, cuts = align_texts(pair, raw_texts(batch.column("_text")))
                n = batch.num_rows
                # The first row of a block has its pairs too.
                at = np.full(n + 1, len(pairs[0]))
                at[0] = 0
                lists = [*((cuts, x) for x in held), *((at, x) for x in pairs)]
                made = [pa.array(x) for x in [*columns, np.full(n, block)]]
                made += [pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(x)) for o, x in lists]
                made = [x.cast(f.type) for x, f in zip(made, list(arrow)[len(names) :])]
                block += 1
                kept = [batch.column(i).cast(arrow.field(i).type) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*kept, *made], schema=arrow)

    aligned = cut_lineage(rows.mapInArrow(run, schema))
    answers = _pair_counts(aligned).withColumnRenamed("_block", "_to")
    out = StructType([*[rows.schema[x] for x in names], *StructType.fromDDL(_COUNTED).fields])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        ordered = right.sort_by("_i")
        count, best = (ordered.column(c).to_numpy().astype(np.int64) for c in ("_count", "_best"))
        left = left.combine_chunks()
        number, times = (left.column(c).combine_chunks() for c in ("_pair", "_times"))
        at = number.offsets.to_numpy()
        number = number.values.to_numpy()
        times = times.values.to_numpy().astype(np.int64)
        sums = [np.concatenate([[0], np.cumsum(x)])[at] for x in (times * best[number], times * count[number])]
        shown = left.select([*names, "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
        for name, total in zip(("n_best", "count_sum"), sums):
            shown = shown.append_column(name, pa.array(np.diff(total)))
        return shown

    done = aligned.drop("_a", "_b", "_m").groupBy("_block").cogroup(answers.groupBy("_to")).applyInArrow(finish, out)
    return done.select(*[F.col(x).alias(c) for c, x in zip(given, names)], *new)


def _pair_counts(aligned: DataFrame) -> DataFrame:
    """``(_block, _i, _count, _best)`` of the pairs of each block: links of the corpus with that pair, and
    whether no other pair with the same B id has more."""
    pairs = aligned.where(F.size("_a") > 0).select(
        "_block", F.posexplode(F.arrays_zip("_a", "_b", "_m")).alias("_i", "_p")
    )
    pairs = pairs.select("_block", "_i", F.col("_p._a").alias("_a"), F.col("_p._b").alias("_b"), F.col("_p._m").alias("_m"))
    counts = cut_lineage(pairs.groupBy("_a", "_b").agg(F.sum("_m").alias("_count")))
    # One row per entry of a vocabulary.
    most = F.broadcast(counts.groupBy("_b").agg(F.max("_count").alias("_most")))
    return pairs.join(counts.join(most, "_b"), ["_a", "_b"]).select(
        "_block", "_i", "_count", (F.col("_count") == F.col("_most")).alias("_best")
    )
