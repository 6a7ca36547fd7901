"""Near-duplicate documents: one-permutation MinHash with optimal densification.

The distinct word shingles of a text are hashed once. The hash space is cut into
equal bins and the smallest hash of each bin is a row of the signature; an empty bin
takes the row of a bin that a fixed sequence of random choices finds first. Bands of
rows make buckets, buckets give star-shaped candidates (``stars``), and
candidates are confirmed on their full shingle sets. Texts with equal sets are one
vertex from the start, however many rows they have.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField

from ..sources.scratch import cut_lineage
from .batches import append_columns, raw_texts
from .prefilter import flag_known, keep_known, key_bitmap
from .stars import shared_buckets, similar_links

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

# Words a worker remembers with their hashes.
KNOWN_WORDS = 500_000
_KNOWN: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(raw: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles.

    Words are runs without ASCII white space, A to Z folded. Fewer words than ``width`` are
    one shingle, no words give an empty set.
    """
    words = raw.translate(_FOLD).split() if raw else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(_KNOWN) > KNOWN_WORDS:
        _KNOWN.clear()
    for w in set(words):
        if w not in _KNOWN:
            _KNOWN[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(_KNOWN.__getitem__, words), np.uint64, len(words))
    n = min(width, len(h))
    code = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        code = _mix(code) * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
    return np.unique(_mix(code + np.uint64(n)))


@lru_cache(maxsize=4)
def _bounds(bins: int) -> np.ndarray:
    return np.array([-(-(i << 64) // bins) for i in range(bins)], np.uint64)


@lru_cache(maxsize=4096)
def _choice(bins: int, attempt: int) -> np.ndarray:
    at = np.arange(bins, dtype=np.uint64) + np.uint64(1)
    return (_mix(at * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)


def signature(shingles: np.ndarray, bins: int) -> np.ndarray:
    """Densified one-permutation signature of a non-empty sorted set."""
    first = np.searchsorted(shingles, _bounds(bins))
    full = first < np.append(first[1:], len(shingles))
    donor = np.where(full, np.arange(bins), -1)
    attempt = 0
    while (empty := donor < 0).any():
        tried = _choice(bins, attempt)
        donor = np.where(empty & full[tried], tried, donor)
        attempt += 1
    return shingles[first[donor]]


def band_keys(signature_: np.ndarray, bands: int) -> np.ndarray:
    rows = signature_.reshape(bands, -1)
    key = np.arange(bands, dtype=np.uint64)
    for k in range(rows.shape[1]):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)


def _sketches(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """``(_id, n_shingles, fp, keys)``; fp and keys are null for an empty set."""

    def sketch(batch: pa.RecordBatch) -> list[list]:
        sizes, prints, keys = [], [], []
        for raw in raw_texts(batch.column("_text")):
            s = shingle_set(raw, width)
            sizes.append(len(s))
            prints.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            keys.append(band_keys(signature(s, bands * rows), bands) if len(s) else None)
        return [sizes, prints, keys]

    fields = [
        StructField("n_shingles", LongType()),
        StructField("fp", BinaryType()),
        StructField("keys", ArrayType(LongType())),
    ]
    return append_columns(docs, ["_text"], fields, sketch, text="_text", keep=["_id"])


def _full_sets(docs: DataFrame, width: int) -> DataFrame:
    """``(fp, shingles)``."""

    def full(batch: pa.RecordBatch) -> list[list]:
        sets = [shingle_set(raw, width) for raw in raw_texts(batch.column("_text"))]
        return [[xxhash.xxh3_128_digest(s.tobytes()) for s in sets], [s.view(np.int64) for s in sets]]

    fields = [StructField("fp", BinaryType()), StructField("shingles", ArrayType(LongType()))]
    return append_columns(docs, ["_text"], fields, full, text="_text", keep=[])


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    bands: int = 24,
    rows: int = 5,
) -> DataFrame:
    """``(id, n_shingles, component_id, kept)``, one row for each row of ``docs``.

    Two texts are linked if ``100 * |A & B| >= percent * |A | B|`` for their sets of ``width``-word
    shingles; ``component_id`` is the smallest id that links reach, ``kept`` says that it is the
    row's own. Null and empty texts, and texts without words, have size 0 and stand
    alone. Rows that share an id and a text are kept or dropped together. A null id counts as
    larger than all others, and a group of null ids only is kept whole.

    Shuffled are sketches (about 250 bytes a document), once the texts of documents that
    share a bucket, and their sets for each confirmed pair. Equal sets are one vertex by a
    pre-aggregated group, so a third of all rows may be copies of one text.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    sketches = cut_lineage(_sketches(base, width, bands, rows))
    some = sketches.where(F.col("fp").isNotNull())
    classes = cut_lineage(
        some.groupBy("fp").agg(
            F.min("_id").alias("rep"), F.first("keys").alias("keys")
        )
    )
    shared = shared_buckets(classes.select(F.explode("keys").alias("key"), F.col("fp").alias("v")))
    sizes = classes.join(shared.select(F.col("v").alias("fp")).distinct(), "fp", "left_semi").select(
        "fp", "rep"
    )
    wanted = cut_lineage(sizes.select(F.col("rep").alias("_rep")).distinct())
    likely = keep_known(base, F.xxhash64("_id"), key_bitmap(F.xxhash64("_rep"), wanted))
    texts = likely.join(wanted, F.col("_id").eqNullSafe(F.col("_rep")), "left_semi")
    sets = _full_sets(texts, width).join(sizes.select("fp"), "fp", "left_semi").dropDuplicates(["fp"])
    sets = cut_lineage(sets.select(F.col("fp").alias("v"), F.col("shingles").alias("items")))

    _, labels = similar_links(shared, sets, percent)
    named = classes.join(labels.select(F.col("v").alias("fp"), "label"), "fp", "left").select(
        "fp", "rep", F.coalesce("label", "fp").alias("label")
    )
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    component = named.join(least, "label").select("fp", "component_id")
    return (
        sketches.select("_id", "n_shingles", "fp").join(component, "fp", "left")
        .withColumn("component_id", F.when(F.col("fp").isNull(), F.col("_id")).otherwise(F.col("component_id")))
        .select(
            F.col("_id").alias(id_col), "n_shingles", "component_id",
            F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"),
        )
    )


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that stand for their component, columns as they came, whatever their names are."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    key, text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    hidden = docs.toDF(*names)
    found = near_duplicates(hidden, id_col=key, text_col=text, **options)
    gone = cut_lineage(found.where(~F.col("kept")).select(F.col(key).alias("_gone")).distinct())
    bitmap = key_bitmap(F.xxhash64("_gone"), gone)
    flagged = flag_known(hidden, F.xxhash64(F.col(key)), bitmap, "_maybe_gone")
    rest = flagged.where("_maybe_gone").join(gone, F.col(key).eqNullSafe(F.col("_gone")), "left_anti")
    return flagged.where("not _maybe_gone").union(rest).select(*names).toDF(*docs.columns)
