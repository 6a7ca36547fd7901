"""Benchmark decontamination: which words of a document repeat a benchmark item.

A window is ``width`` consecutive words of an item (the whole item if it is
shorter, nothing if it has no words); a document is searched for exact
occurrences of windows. It is a set join with containment 1 on item-sized
windows, so the prefix that a match must share is one token: the word of the
window that the fewest documents have. Documents are joined on that word only; the
position of the word bounds where the window would start, its length where
it would end, and the words in between are compared exactly.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .batches import append_columns, raw_texts, slices

# Bytes that separate words become spaces, A to Z become a to z.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)

SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))
FIELDS = [
    StructField("n_words", LongType()),
    StructField("hit_spans", SPANS),
    StructField("hit_items", ArrayType(StringType())),
]

# A block of windows is a broadcast table: so many windows of ``width`` words at most.
WINDOWS_PER_BLOCK = 100_000


def words_of(raw: bytes | None) -> list[bytes]:
    """Lower-cased words of a UTF-8 text: runs of digits, a to z and non-ASCII characters."""
    return raw.translate(_FOLD).split() if raw else []


def benchmark_windows(items: DataFrame, item_col: str, text_col: str, width: int) -> DataFrame:
    """``(item, words)``: the distinct windows of each item, item ids as strings."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                ids, found = [], []
                for item, raw in zip(batch.column("_item").to_pylist(), raw_texts(batch.column("_text"))):
                    w = words_of(raw)
                    for i in range(max(1, len(w) - width + 1) if w else 0):
                        ids.append(item)
                        found.append(b" ".join(w[i : i + width]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.string()), pa.array(found, pa.binary()).cast(pa.string())],
                    names=["item", "words"],
                )

    return (
        items.select(
            F.col(item_col).cast("string").alias("_item"), F.col(text_col).cast("string").alias("_text")
        )
        .mapInArrow(cut, "item string, words string")
        .distinct()
    )


def document_frequency(docs: DataFrame, text_col: str, vocabulary: set[bytes]) -> dict[bytes, int]:
    """In how many of all documents each word of a bounded vocabulary occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        wanted = shared.value
        for batch in batches:
            for raw in raw_texts(batch.column(0)):
                seen.update(wanted.intersection(words_of(raw)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
            names=["word", "n"],
        )

    counted = (
        docs.select(F.col(text_col).cast("string").alias("_text"))
        .mapInArrow(count, "word binary, n bigint")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
    )
    return {bytes(r.word): r.n for r in counted.collect()}  # at most one row per vocabulary word


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def mark_benchmark(
    docs: DataFrame,
    items: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 10,
    windows_per_block: int = WINDOWS_PER_BLOCK,
) -> DataFrame:
    """Documents plus ``n_words``, ``hit_spans`` and ``hit_items``.

    ``hit_spans`` are disjoint word ranges ``[start, end)`` in order, ``hit_items`` the
    sorted ids, as strings, of the items with an occurring window. Documents are
    only read: no shuffle, and a document is held by one task at a time. The benchmark
    is broadcast in blocks of ``windows_per_block`` windows, each a pass over the rows of
    the former, so its size is bounded however large the benchmark is.

    Null or empty text has no words and no hits. Repeated items count once, an item
    without an id marks words but is not listed. Repeated documents are judged each.
    Existing columns with the new names are replaced.
    """
    windows = benchmark_windows(items, item_col, item_text_col, width)
    blocks = max(1, -(-windows.select("words").distinct().count() // windows_per_block))
    marked = docs
    for block in range(blocks):
        part = windows.where(F.expr(f"pmod(xxhash64(words), {blocks}) = {block}")) if blocks > 1 else windows
        owners: dict[bytes, list[str]] = defaultdict(list)
        for row in part.collect():  # a bounded block of the benchmark
            owners[row.words.encode()] += [row.item] if row.item is not None else []
        frequency = document_frequency(docs, text_col, {w for key in owners for w in key.split(b" ")})
        index: dict[bytes, list[tuple[int, list[bytes], list[str]]]] = defaultdict(list)
        for key, item_ids in owners.items():
            window = key.split(b" ")
            rarest = min(window, key=lambda w: (frequency.get(w, 0), w))
            if frequency.get(rarest, 0):  # else no document can hold the window
                index[rarest].append((window.index(rarest), window, item_ids))
        shared = docs.sparkSession.sparkContext.broadcast(dict(index))
        first = block == 0

        def search(batch: pa.RecordBatch, shared=shared, first=first) -> list[list]:
            table = shared.value
            n_words, spans_out, items_out = [], [], []
            before = None if first else list(
                zip(batch.column("hit_spans").to_pylist(), batch.column("hit_items").to_pylist())
            )
            for i, raw in enumerate(raw_texts(batch.column(0).cast(pa.string()))):
                w = words_of(raw)
                spans = [] if before is None else [(s["start"], s["end"]) for s in before[i][0]]
                found = set() if before is None else set(before[i][1])
                for rare in table.keys() & set(w):
                    at = w.index(rare)
                    while at >= 0:
                        for offset, window, item_ids in table[rare]:
                            start = at - offset
                            if start >= 0 and w[start : start + len(window)] == window:
                                spans.append((start, start + len(window)))
                                found.update(item_ids)
                        try:
                            at = w.index(rare, at + 1)
                        except ValueError:
                            at = -1
                n_words.append(len(w))
                spans_out.append([{"start": s, "end": e} for s, e in _merge(spans)])
                items_out.append(sorted(found))
            return [n_words, spans_out, items_out]

        inputs = [text_col] if first else [text_col, "hit_spans", "hit_items"]
        marked = append_columns(marked, inputs, FIELDS, search, text=text_col)
    return marked


def with_contamination(marked: DataFrame) -> DataFrame:
    """Add ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated`` to marked documents."""
    return marked.withColumns(
        {
            "n_hit": F.expr("aggregate(hit_spans, 0L, (n, s) -> n + s.end - s.start)"),
            "n_items": F.size("hit_items").cast("bigint"),
            "items_sha256": F.sha2(F.array_join("hit_items", ","), 256),
        }
    ).withColumn("contaminated", F.col("n_hit") > 0)


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents without a benchmark window, columns as they came."""
    marked = mark_benchmark(docs, items, **options)
    return marked.where(F.size("hit_spans") == 0).select(*docs.columns)
