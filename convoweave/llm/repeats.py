"""Substring dedup: word sequences of a given length that an earlier document holds too are cut out.

Seed and extend. Seeds are winnowed anchors: in every window of ``length`` words the run of ``SEED`` words with the
smallest hash, the leftmost of equals, so that equal windows have equal anchors at the same place, whatever
surrounds them. Documents meet on their anchors. An anchor is extended both ways over all windows that chose
it, its reach. Where the whole reach equals that of an earlier document, all of it is a repeat, which goes on
into the reach of the next anchor. Where documents share an anchor but not the whole reach, the first holder of each
reach is compared window by window, which finds how far the match extends to either side. Adjoining windows
are joined into maximal repeats; they are of ``length`` words at least, and shorter ones never arise.

Only the first document that holds a window matters, so a group of copies is aggregated to one row for each
reach before it is shuffled, and no pairs of documents are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from ..sources.scratch import cut_lineage
from .batches import append_columns, raw_texts, slices
from .prefilter import flag_known, keep_known, key_bitmap

# Words of an anchor.
SEED = 10

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of every word of all texts, and where each text begins. Words are cut at ASCII white space."""
    split = [t.split() if t else [] for t in texts]
    words = pa.array([w for ws in split for w in ws], pa.binary()).dictionary_encode()
    pairs = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words.dictionary.to_pylist())), np.uint64).reshape(-1, 2)
    codes = words.indices.to_numpy()
    cuts = np.concatenate([[0], np.cumsum([len(ws) for ws in split], dtype=np.int64)])
    return pairs[codes, 0], pairs[codes, 1], cuts


def run_hashes(h: np.ndarray, base: np.uint64, n: int) -> np.ndarray:
    """Polynomial hash of the ``n`` words from each word on, put together from runs of powers of two."""
    out, have = np.zeros(len(h), np.uint64), 0
    run, size, power = h, 1, int(base)
    while size <= n:
        if n & size:
            left = len(h) - have - size + 1
            if left <= 0:
                return out[:0]
            out = out[:left] * np.uint64(power) + run[have : have + left]
            have += size
        run = run[: max(len(run) - size, 0)] * np.uint64(power) + run[size:]
        power = power * power % (1 << 64)
        size *= 2
    return out


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Where the smallest of ``width`` values from each place on stands; of equals the leftmost."""
    place = np.arange(len(values))

    def join(step: int) -> None:
        nonlocal values, place
        left = values[:-step] <= values[step:]
        values = np.where(left, values[:-step], values[step:])
        place = np.where(left, place[:-step], place[step:])

    size = 1
    while 2 * size <= width:
        join(size)
        size *= 2
    if size < width:
        join(width - size)
    return place


def windows(cuts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows that lie inside one text, and the texts."""
    counts = np.maximum(np.diff(cuts) - length + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    first = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + cuts[:-1][text]
    return first, text


def reaches(texts: list[bytes | None], length: int) -> dict[str, np.ndarray]:
    """One entry per anchor: its text, first window, number of windows, hash of the anchor and of the reach."""
    h1, h2, cuts = word_hashes(texts)
    first, text = windows(cuts, length)
    if not len(first):
        empty = np.zeros(0, np.int64)
        return {"text": empty, "start": empty, "windows": empty, "anchor": empty, "reach": empty}
    seed = min(SEED, length)
    grams = _mix(run_hashes(h1, _BASES[0], seed))
    anchor = leftmost_minima(grams, length - seed + 1)[first]
    new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])))
    count = np.diff(np.append(new, len(first)))
    # A reach is at most two windows long, so its first and last window cover it.
    whole = run_hashes(h2, _BASES[1], length)
    start, end = first[new], first[new + count - 1]
    reach = _mix(_mix(whole[start]) * _BASES[0] + whole[end] + count.astype(np.uint64))
    return {
        "text": text[new],
        "start": start - cuts[text[new]],
        "windows": count,
        "anchor": grams[anchor[new]].view(np.int64),
        "reach": reach.view(np.int64),
    }


def _later(id_: Column, least: Column) -> Column:
    """Whether a document with a smaller id is known; a null id is larger than all others."""
    return least.isNotNull() & (id_.isNull() | (id_ > least))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(_id, _key, _text)``; rows equal in id and text have equal keys."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col), text).alias("_key"), text.alias("_text"))


def _with_marks(base: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows of ``base`` that have marks, with these."""
    likely = keep_known(base, F.col("_key"), key_bitmap(F.col("_key"), marks))
    held = marks.withColumnsRenamed({"_id": "_mark_id", "_key": "_mark_key"})
    met = (F.col("_key") == F.col("_mark_key")) & F.col("_id").eqNullSafe(F.col("_mark_id"))
    return likely.join(held, met).drop("_mark_id", "_mark_key")


def repeated_stretches(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50
) -> DataFrame:
    """``(_id, _key, stretches)``: for rows that repeat an earlier document, the maximal repeats.

    ``stretches`` are ``(start, end)`` in words, end-exclusive and in order: every word that is covered by a window
    of ``length`` words which also starts in a document with a smaller id. A null id is larger than all others;
    rows with one id are not earlier than each other, and rows equal in id and text share a key. Texts shorter than a window,
    empty and null ones are not listed. Words are compared by two 64-bit hashes of their runs.
    """
    if length < 1:
        raise ValueError(f"length must be positive, got {length}")
    base = _keyed(docs, id_col, text_col)
    id_type = base.schema["_id"].dataType.simpleString()

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                with np.errstate(over="ignore"):
                    found = reaches(raw_texts(batch.column("_text")), length)
                at = pa.array(found["text"])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_id").take(at), batch.column("_key").take(at),
                        pa.array(found["start"].astype(np.int32)), pa.array(found["windows"].astype(np.int32)),
                        pa.array(found["anchor"]), pa.array(found["reach"]),
                    ],
                    names=["_id", "_key", "_start", "_windows", "_anchor", "_reach"],
                )

    spans = cut_lineage(
        base.mapInArrow(seeds, f"_id {id_type}, _key bigint, _start int, _windows int, _anchor bigint, _reach bigint")
    )
    # Documents meet on anchors: those that stand at one place only are done.
    often = spans.groupBy("_anchor").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_anchor")
    often = cut_lineage(often)
    met = keep_known(spans, F.col("_anchor"), key_bitmap(F.col("_anchor"), often)).join(often, "_anchor")
    met = cut_lineage(met)
    # One row per reach, and whether its anchor has others.
    held = cut_lineage(met.groupBy("_anchor", "_reach").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_n")))
    several = cut_lineage(held.groupBy("_anchor").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").select("_anchor"))
    several = several.withColumn("_open", F.lit(True))
    held = held.join(several, "_anchor", "left").where("_n > 1 or _open").drop("_n")
    held = cut_lineage(held.withColumn("_open", F.coalesce("_open", F.lit(False))))
    known = met.join(held, ["_anchor", "_reach"]).withColumn("_whole", _later(F.col("_id"), F.col("_least")))
    known = cut_lineage(known.where("_whole or _open").select("_id", "_key", "_start", "_windows", "_whole"))

    # First holders of a reach whose anchor has others: window by window.
    place = F.struct("_start", "_windows")
    open_ = known.where("not _whole").groupBy("_id", "_key").agg(F.collect_set(place).alias("_open"))
    frames = _frames(base, cut_lineage(open_), length, id_type)
    first = frames.groupBy("_f", "_g").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_n"))
    first = cut_lineage(first.where("_n > 1 and _least is not null").drop("_n"))
    likely = keep_known(frames, F.col("_f"), key_bitmap(F.col("_f"), first))
    hits = likely.join(first, ["_f", "_g"]).where(_later(F.col("_id"), F.col("_least")))
    gone = known.where("_whole").select("_id", "_key", "_start", "_windows").union(
        hits.select("_id", "_key", "_start", F.lit(1).alias("_windows"))
    )
    places = gone.groupBy("_id", "_key").agg(F.sort_array(F.collect_set(place)).alias("_places"))
    return places.select("_id", "_key", _joined(F.col("_places"), length).alias("stretches"))


def _frames(base: DataFrame, open_: DataFrame, length: int, id_type: str) -> DataFrame:
    """``(_id, _key, _start, _f, _g)``: hashes of the windows of open reaches."""

    def hash_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                h1, h2, cuts = word_hashes(raw_texts(batch.column("_text")))
                with np.errstate(over="ignore"):
                    f, g = (run_hashes(h, b, length) for h, b in zip((h1, h2), _BASES))
                column = batch.column("_open")
                sizes = column.value_lengths().to_numpy()
                fields = column.flatten()
                start, count = (fields.field(c).to_numpy() for c in ("_start", "_windows"))
                row = np.repeat(np.repeat(np.arange(batch.num_rows), sizes), count)
                inside = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                at = np.repeat(start, count) + inside
                of = cuts[:-1][row] + at
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_id").take(pa.array(row)), batch.column("_key").take(pa.array(row)),
                        pa.array(at.astype(np.int32)), pa.array(f[of].view(np.int64)), pa.array(g[of].view(np.int64)),
                    ],
                    names=["_id", "_key", "_start", "_f", "_g"],
                )

    texts = _with_marks(base, open_).select("_id", "_key", "_text", "_open")
    return cut_lineage(texts.mapInArrow(hash_windows, f"_id {id_type}, _key bigint, _start int, _f bigint, _g bigint"))


def _joined(places: Column, length: int) -> Column:
    """Stretches of sorted runs of windows, those that touch or overlap as one."""
    ends = F.transform(places, lambda p: F.struct(p["_start"].alias("start"), (p["_start"] + p["_windows"] + (length - 1)).alias("end")))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(state: Column, x: Column) -> Column:
        grown = F.struct(state["at"]["start"].alias("start"), F.greatest(state["at"]["end"], x["end"]).alias("end"))
        more = F.when(state["at"].isNull(), state["done"]).otherwise(F.array_append(state["done"], state["at"]))
        return F.when(
            state["at"].isNotNull() & (x["start"] <= state["at"]["end"]),
            F.struct(state["done"].alias("done"), grown.alias("at")),
        ).otherwise(F.struct(more.alias("done"), x.alias("at")))

    start = F.struct(none.alias("done"), F.lit(None).cast("struct<start:int,end:int>").alias("at"))
    return F.aggregate(ends, start, step, lambda s: F.array_append(s["done"], s["at"]))


def drop_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50
) -> DataFrame:
    """Documents without the words of ``repeated_stretches``, plus ``n_words`` and ``n_removed``.

    The text becomes its remaining words, joined by one space; no row goes. A null text stays null and
    has no words. Columns with the new names are replaced. Texts are shuffled only where an earlier document
    holds an anchor too.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    key, text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    hidden = docs.toDF(*names)
    found = cut_lineage(repeated_stretches(hidden, id_col=key, text_col=text, length=length))
    known = hidden.withColumns({"_id": F.col(key), "_key": F.xxhash64(F.col(key), F.col(text).cast("string"))})
    flagged = flag_known(known, F.col("_key"), key_bitmap(F.col("_key"), found), "_maybe")
    marks = found.withColumnsRenamed({"_id": "_mark_id", "_key": "_mark_key"})
    met = (F.col("_key") == F.col("_mark_key")) & F.col("_id").eqNullSafe(F.col("_mark_id"))
    cut = flagged.where("_maybe").join(marks, met, "left").select(*names, "stretches")
    rest = flagged.where("not _maybe").select(*names, F.lit(None).cast(found.schema["stretches"].dataType).alias("stretches"))

    def keep(batch: pa.RecordBatch) -> list[list]:
        kept, n_words, n_removed = [], [], []
        for raw, stretches in zip(raw_texts(batch.column(text).cast(pa.string())), batch.column("stretches").to_pylist()):
            words = raw.split() if raw else []
            n_words.append(len(words))
            for s in reversed(stretches or []):
                del words[s["start"] : s["end"]]
            n_removed.append(n_words[-1] - len(words))
            kept.append(None if raw is None else b" ".join(words).decode("utf-8", "replace"))
        return [kept, n_words, n_removed]

    new = [StructField("_kept", StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType())]
    done = append_columns(rest.union(cut), [text, "stretches"], new, keep, text=text, keep=names)
    given = [
        F.col("_kept" if n == text else n).alias(c) for n, c in zip(names, docs.columns) if c not in ("n_words", "n_removed")
    ]
    return done.select(*given, "n_words", "n_removed")
