"""Language-model scores of texts with a log-frequency Bloom filter.

Words are counted over all training texts (``word_blocks`` brings each block the counts of
its words). Pairs of neighbouring tokens are counted by 64-bit hashes, pre-aggregated
where they are read and summed by segments of the hash space. A pair seen ``c`` times has level
``1 + floor(log2 c)``, and the filter holds the pair with each level from the first up to its own;
probing level after level until one is missing gives the count back, up to its power
of two. Pairs below ``min_count`` are left out, at any size of the corpus; the filter has a fixed number of
bits for each entry, so it grows with the counted pairs. It is never whole in one place: texts are scored against
blocks of its segments, ``block_bytes`` of each broadcast, and the terms of the tokens whose pair belongs to a block are summed.

A token's probability mixes the pair estimate and the smoothed word estimate
``(c + 0.5) / (N + 0.5 (V + 1))``; the weight of the pair grows with the count of the word before it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut_lineage
from .batches import raw_texts, slices
from .near_dedup import _mix
from .word_blocks import block_words, finish_blocks, pack_blocks, unpack

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_EDGE = np.uint64(0x5851F42D4C957F2D)  # stands for the start and the end of a text

# Pairs that one segment of the hash space is made for, and the most levels of a count.
PAIRS_PER_SEGMENT = 500_000
LEVELS = 48
PROBES = 4
# Tokens that are looked up together.
TOKENS_AT_ONCE = 1 << 18


def lm_words(raw: bytes | None) -> list[bytes]:
    """Runs without ASCII white space, A to Z folded."""
    return raw.translate(_FOLD).split() if raw else []


def pair_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of (word, next word) from the start edge to the end edge; one more than words."""
    return _pair(np.append(_EDGE, words), np.append(words, _EDGE))


def _pair(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return _mix(_mix(before * _GOLDEN + np.uint64(1)) + after)


def _levels(counts: np.ndarray) -> np.ndarray:
    return np.minimum(LEVELS, 1 + np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64))


@dataclass(frozen=True)
class Filter:
    """Bits in segments of equal size; a pair's segment comes from the upper half of its hash.

    Holds ``segments`` in all, or those from ``start`` on that ``bits`` has rows for.
    """

    bits: np.ndarray  # [segments held, bytes of a segment]
    start: int = 0
    segments: int | None = None

    def owns(self, hashes: np.ndarray) -> np.ndarray:
        """Which pairs belong to the segments held."""
        if self.segments is None:
            return np.ones(len(hashes), bool)
        at = segment_of(hashes, self.segments) - self.start
        return (at >= 0) & (at < len(self.bits))

    def has(self, hashes: np.ndarray, level: int) -> np.ndarray:
        held, width = self.bits.shape
        segment = segment_of(hashes, self.segments or held) - self.start
        found = np.ones(len(hashes), bool)
        for at in positions(hashes, level, width * 8):
            found &= (self.bits[segment, at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
        return found

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """Lower ends of the counts' powers of two; 0 for a pair that is not there."""
        out = np.zeros(len(hashes))
        if not self.bits.size:
            return out
        live = np.arange(len(hashes))
        for level in range(1, LEVELS + 1):
            live = live[self.has(hashes[live], level)]
            if not len(live):
                break
            out[live] = 2.0 ** (level - 1)
        return out


def segment_of(hashes: np.ndarray, segments: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)


def positions(hashes: np.ndarray, level: int, n_bits: int) -> Iterator[np.ndarray]:
    one = _mix(hashes + np.uint64(level * int(_GOLDEN) & 0xFFFFFFFFFFFFFFFF))
    step = one >> np.uint64(33) | np.uint64(1)
    for k in range(PROBES):
        yield ((one + np.uint64(k) * step) % np.uint64(n_bits)).astype(np.int64)


def _segment_counts(texts: DataFrame, segments: int, least: int) -> DataFrame:
    """``(segment, hashes, counts)``: the pairs of all texts, summed; one row a segment.

    A map task sends each segment its distinct pairs of a slice as one compressed row.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        codec = pa.Codec("zstd")
        for whole in batches:
            for batch in slices(whole, "text"):
                found = []
                for raw in raw_texts(batch.column("text")):
                    words = lm_words(raw)
                    for w in set(words):
                        if w not in known:
                            known[w] = xxhash.xxh64_intdigest(w)
                    found.append(pair_hashes(np.fromiter(map(known.__getitem__, words), np.uint64, len(words))))
                    if len(known) > 500_000:
                        known.clear()
                hashes, counts = np.unique(np.concatenate(found), return_counts=True)
                cuts = np.searchsorted(segment_of(hashes, segments), np.arange(segments + 1))
                rows = [(s, cuts[s], cuts[s + 1]) for s in range(segments) if cuts[s] < cuts[s + 1]]
                # Differences of sorted hashes as planes of bytes: the upper ones are zeros.
                packed = []
                for _, a, b in rows:
                    gaps = np.diff(hashes[a:b], prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
                    packed.append(codec.compress(np.ascontiguousarray(gaps).tobytes(), asbytes=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([s for s, _, _ in rows], pa.int64()),
                        pa.array([int(b - a) for _, a, b in rows], pa.int64()),
                        pa.array(packed, pa.binary()),
                        pa.array(
                            [codec.compress(counts[a:b].astype("<u4").tobytes(), asbytes=True) for _, a, b in rows],
                            pa.binary(),
                        ),
                    ],
                    names=["segment", "n", "hashes", "counts"],
                )

    def total(table: pa.Table) -> pa.Table:
        codec = pa.Codec("zstd")
        hashes, counts = [], []
        for n, h, c in zip(*(table.column(k).to_pylist() for k in ("n", "hashes", "counts"))):
            planes = np.frombuffer(codec.decompress(h, n * 8, asbytes=True), np.uint8).reshape(8, n)
            hashes.append(np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64))
            counts.append(np.frombuffer(codec.decompress(c, n * 4, asbytes=True), "<u4"))
        all_hashes, all_counts = np.concatenate(hashes), np.concatenate(counts)
        order = np.argsort(all_hashes, kind="stable")
        all_hashes, all_counts = all_hashes[order], all_counts[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], all_hashes[1:] != all_hashes[:-1]]))
        sums = np.add.reduceat(all_counts, first)
        often = sums >= least
        levels = np.bincount(_levels(sums), minlength=LEVELS + 1)
        return pa.table(
            {
                "segment": pa.array([table.column("segment")[0].as_py()], pa.int64()),
                "levels": pa.array([levels.tolist()], pa.list_(pa.int64())),
                "hashes": pa.array([all_hashes[first][often].tobytes()], pa.binary()),
                "counts": pa.array([sums[often].astype("<u4").tobytes()], pa.binary()),
            }
        )

    return (
        texts.mapInArrow(count, "segment bigint, n bigint, hashes binary, counts binary")
        .groupBy("segment")
        .applyInArrow(total, "segment bigint, levels array<bigint>, hashes binary, counts binary")
    )


@dataclass(frozen=True)
class PairCounts:
    """Counted pairs in shared storage, by segment, and how many there are of each level."""

    counted: DataFrame  # (segment, hashes, counts)
    segments: int
    per_level: dict[int, int]
    least: int
    bits_per_entry: int

    def entries(self, least: int) -> int:
        return sum(n * level for level, n in self.per_level.items() if level > math.log2(least))

    def width(self, least: int) -> int:
        """Bytes of a segment."""
        return max(1, -(-self.entries(least) * self.bits_per_entry // (8 * self.segments)))

    def block(self, start: int, stop: int, least: int | None = None) -> Filter:
        """The filter's segments from ``start`` to ``stop``, gathered on the driver."""
        least = least or self.least
        width = self.width(least)

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bits = []
                for h, c in zip(batch.column("hashes").to_pylist(), batch.column("counts").to_pylist()):
                    hashes, counts = np.frombuffer(h, np.uint64), np.frombuffer(c, "<u4")
                    hashes, level = hashes[counts >= least], _levels(counts[counts >= least])
                    row = np.zeros(width * 8, bool)
                    for j in range(1, int(level.max(initial=0)) + 1):
                        for at in positions(hashes[level >= j], j, width * 8):
                            row[at] = True
                    bits.append(np.packbits(row, bitorder="little").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("segment"), pa.array(bits, pa.binary())], names=["segment", "bits"])

        filled = np.zeros((stop - start, width), np.uint8)
        part = self.counted.where(F.col("segment").between(start, stop - 1)).select("segment", "hashes", "counts")
        for row in part.mapInArrow(fill, "segment bigint, bits binary").toLocalIterator():
            filled[row.segment - start] = np.frombuffer(row.bits, np.uint8)
        return Filter(filled, start, self.segments)


def count_pairs(texts: DataFrame, *, text_col: str = "text", min_count: int = 2, bits_per_entry: int = 10) -> PairCounts:
    """Count all pairs of all texts and keep those seen ``min_count`` times."""
    plain = texts.select(F.col(text_col).cast("string").alias("text"))
    total = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # About seven bytes a word; segments are counted by the size of the corpus.
    segments = max(16, min(1 << 20, total // (7 * PAIRS_PER_SEGMENT)))
    least = max(1, min_count)
    counted = cut_lineage(_segment_counts(plain, segments, least))
    histogram = counted.select(F.posexplode("levels").alias("level", "n")).groupBy("level").agg(F.sum("n").alias("n"))
    return PairCounts(counted, segments, {r.level: r.n for r in histogram.collect()}, least, bits_per_entry)


def build_filter(
    texts: DataFrame, *, text_col: str = "text", min_count: int = 2, bits_per_entry: int = 10, max_filter_bytes: int | None = None
) -> Filter:
    """The whole filter on the driver, for corpora where it fits; ``score_texts`` takes it in blocks instead.

    Only where a caller bounds it by ``max_filter_bytes`` is ``min_count`` doubled until it fits.
    """
    pairs = count_pairs(texts, text_col=text_col, min_count=min_count, bits_per_entry=bits_per_entry)
    least = pairs.least
    while max_filter_bytes is not None and pairs.entries(least) * bits_per_entry > 8 * max_filter_bytes:
        least *= 2
    return pairs.block(0, pairs.segments, least) if pairs.entries(least) else Filter(np.zeros((0, 0), np.uint8))


SCHEMA = (
    "doc_id {id}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
    "base_score double, score double, _row binary"
)


def score_texts(
    docs: DataFrame,
    held_out_col: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    weight: float = 0.5,
    half: float = 200.0,
    block_bytes: int = 64 << 20,
    **count_options,
) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of all texts.

    Learns from the rows where ``held_out_col`` is false (null counts as true). Tokens are the words and
    one end. ``base_score`` is the sum of log10 of the smoothed word estimates, ``score`` that of the
    mixture; ``weight * c / (c + half)`` is the weight of the pair after a word seen ``c`` times. A pair counts
    with the power of two that the filter knows of it, so that the probabilities after a word add up to one at most.
    A null or empty text is one end. Rows with one id are scored each. All pairs of ``min_count`` count; the filter
    is broadcast in blocks of ``block_bytes`` (one segment at least), with a pass over the texts for each block.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.col(held_out_col), F.lit(True))
    base = docs.select(
        F.col(id_col).alias("_id"), held.alias("_held"), (~held).alias("_train"), F.col(text_col).cast("string").alias("_text")
    )
    pairs = count_pairs(base.where("_train").select(F.col("_text").alias("text")), **count_options)
    least = 2.0 ** math.floor(math.log2(pairs.least))
    step = max(1, min(pairs.segments, block_bytes // pairs.width(pairs.least)))
    starts = list(range(0, pairs.segments, step)) if pairs.entries(pairs.least) else []
    packed = pack_blocks(base, "_text", ["_id", "_held", "_train"])
    # Written once: the words of all blocks are summed, and then get their sums back.
    found = cut_lineage(block_words(packed, lm_words, 3, counted=2))
    totals = found.groupBy("word").agg(F.sum("n").alias("c"), F.min("block").alias("owner"))
    joined = found.join(totals, "word")
    answers = cut_lineage(joined.select("block", "i", "c", (F.col("owner") == F.col("block")).alias("owns")))
    texts = base.agg(F.count_if("_train")).first()[0]
    words, kinds = answers.where("owns and c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n_all, v_all = words + texts, kinds + (texts > 0)
    bottom = n_all + 0.5 * (v_all + 1)

    def finish(shared: Broadcast, payloads: pa.Table, known: pa.Table) -> pa.Table:
        filter_ = shared.value
        (ids, held_out, _), raws = unpack(payloads.column("payload"), 3)
        split = [lm_words(raw) for raw in raws]
        vocabulary = sorted({w for words_ in split for w in words_})
        number = {w: i for i, w in enumerate(vocabulary)}
        count = np.zeros(len(vocabulary) + 1)
        count[known.column("i").to_numpy()] = known.column("c").to_numpy()
        count[-1] = texts  # the end
        hashed = np.fromiter((xxhash.xxh64_intdigest(w) for w in vocabulary), np.uint64, len(vocabulary))
        estimate = (count + 0.5) / bottom
        log_estimate = np.log10(estimate)
        end = len(vocabulary)
        edged = np.append(hashed, _EDGE)
        out: dict[str, list] = {k: [] for k in ("n_tokens", "n_known", "base_score", "score")}

        def score(docs_: list[np.ndarray]) -> None:
            # Texts in a row, each closed by an end, which is the start of the next one too.
            tokens = np.concatenate(docs_)
            sizes = np.fromiter(map(len, docs_), np.int64, len(docs_))
            first = np.cumsum(sizes) - sizes
            after = edged[tokens]
            hashes = _pair(np.append(_EDGE, after[:-1]), after)
            owned = filter_.owns(hashes)
            pair = np.zeros(len(tokens))
            pair[owned] = filter_.counts(hashes[owned])
            before = np.append(texts, count[tokens[:-1]])
            share = weight * before / (before + half)
            # A power of two stands for counts from it on, so what all successors of a word are given is no more than its
            # count. No pair is held below the least level: what is found there only is a false hit.
            pair[pair < least] = 0
            seen = np.divide(np.minimum(pair, before), before, out=np.zeros(len(tokens)), where=before > 0)
            mixed = np.where(owned, np.log10(share * seen + (1 - share) * estimate[tokens]), 0.0)
            out["n_tokens"] += sizes.tolist()
            out["n_known"] += np.add.reduceat((count[tokens] > 0).astype(np.int64), first).tolist()
            out["base_score"] += np.add.reduceat(log_estimate[tokens], first).tolist()
            out["score"] += np.add.reduceat(mixed, first).tolist()

        waiting: list[np.ndarray] = []
        held_tokens = 0
        for words_ in split:
            waiting.append(np.append(np.fromiter(map(number.__getitem__, words_), np.int64, len(words_)), end))
            held_tokens += len(words_) + 1
            if held_tokens > TOKENS_AT_ONCE:
                score(waiting)
                waiting, held_tokens = [], 0
        if waiting:
            score(waiting)
        return pa.table(
            {
                "doc_id": pa.array(ids, payload_type),
                "held_out": pa.array(held_out, pa.bool_()),
                "n_tokens": pa.array(out["n_tokens"], pa.int64()),
                "n_known": pa.array(out["n_known"], pa.int64()),
                "train_tokens": pa.array([n_all] * len(ids), pa.int64()),
                "base_score": pa.array(out["base_score"], pa.float64()),
                "score": pa.array(out["score"], pa.float64()),
                "_row": pa.array(
                    [xxhash.xxh3_128_digest(repr((i, h, raw)).encode()) for i, h, raw in zip(ids, held_out, raws)], pa.binary()
                ),
            }
        )

    id_type = docs.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    payload_type = to_arrow_type(id_type)
    schema = SCHEMA.format(id=id_type.simpleString())
    whole = Filter(np.zeros((0, 0), np.uint8))
    if len(starts) > 1:
        # Packed once for all passes.
        packed = cut_lineage(packed)
    passes = []
    for start in starts or [None]:
        model = whole if start is None else pairs.block(start, min(start + step, pairs.segments))
        shared = spark.sparkContext.broadcast(model)
        done = finish_blocks(packed, answers.select("block", "i", "c"), _bound(finish, shared), schema)
        if len(starts) < 2:
            return done.drop("_row").withColumnRenamed("doc_id", id_col)
        # Written at once, so that one block of the filter is held at a time.
        passes.append(cut_lineage(done))
        shared.destroy()
    return _summed(passes).withColumnRenamed("doc_id", id_col)


def _bound(finish: Callable[..., pa.Table], shared: Broadcast) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def bound(payloads: pa.Table, known: pa.Table) -> pa.Table:
        return finish(shared, payloads, known)

    return bound


def _summed(passes: list[DataFrame]) -> DataFrame:
    """One row for each row of a pass, with the scores of all passes added up.

    Rows that are equal in id, text and ``held_out`` have equal scores: a pass counts them.
    """
    same = ["_row", "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"]
    per_pass = [
        p.groupBy(*same[:1]).agg(*[F.first(c).alias(c) for c in same[1:]], F.first("score").alias("score"), F.count(F.lit(1)).alias("_n"))
        for p in passes
    ]
    every = reduce(DataFrame.union, per_pass)
    summed = every.groupBy("_row").agg(
        *[F.first(c).alias(c) for c in same[1:]], F.sum("score").alias("score"), F.first("_n").alias("_n")
    )
    copies = summed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return copies.select(*same[1:], "score")
