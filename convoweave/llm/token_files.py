"""Token-id files: Parquet lists of ids in document order, read in part or whole.

One row per document: ``part`` and ``pos`` (its place in the order), ``doc_id``,
``n_tokens`` and ``ids``. Ids are dictionary-encoded (a vocabulary fits in one
dictionary page, so an id takes the bits of the vocabulary's size), the other
columns are delta-encoded. Row groups and pages are bounded, and pages are indexed,
so that readers of some documents or of the metadata skip the rest.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from .batches import Recent, append_columns, raw_texts, slices

SCHEMA = "part int, pos bigint, doc_id bigint, n_tokens bigint, ids array<int>"

FORMAT = {
    "parquet.writer.version": "v2",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
}

_PLAIN = re.compile(rb"[a-z]+")

# Chunks whose ids a worker remembers, and the longest of them in bytes.
CACHED_CHUNKS = 500_000
CACHED_BYTES = 64

# Turns raw texts into little-endian 32-bit ids, one bytes object per text.
Encoder = Callable[[list[bytes | None]], list[bytes]]


def chunk_encoder(path: str, end_id: int | None) -> Encoder:
    """Encoder of a tokenizer file whose pre-tokens never hold white space.

    Texts are cut at ASCII white space; equal chunks are encoded once while a
    worker remembers them. The memory is bounded and only saves work.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    recent = Recent(CACHED_CHUNKS)
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def make(chunks: list[bytes]) -> list[bytes]:
        out: dict[bytes, bytes] = {}
        # A lower-case word with a comma or full stop is the word and the mark.
        marked = [c for c in chunks if c[-1:] in (b",", b".") and _PLAIN.fullmatch(c[:-1])]
        stems = [c[:-1] for c in marked]
        plain = {c for c in chunks if _PLAIN.fullmatch(c)}
        rest = [c for c in chunks if c not in plain and not (c[-1:] in (b",", b".") and _PLAIN.fullmatch(c[:-1]))]
        # Pre-tokens of a to z are their own byte-level form: the merges apply directly.
        out.update((c, _ids(t.id for t in tokenizer.model.tokenize(c.decode()))) for c in plain)
        for i in range(0, len(rest), 4096):
            part = rest[i : i + 4096]
            texts = [c.decode("utf-8", "replace") for c in part]
            found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            out.update((c, _ids(e.ids)) for c, e in zip(part, found))
        if marked:
            mark = {m: _ids(tokenizer.encode(m.decode(), add_special_tokens=False).ids) for m in (b",", b".")}
            found = recent.lookup(stems, make, CACHED_BYTES)
            out.update((c, ids + mark[c[-1:]]) for c, ids in zip(marked, found))
        return [out[c] for c in chunks]

    def encode(texts: list[bytes | None]) -> list[bytes]:
        out = []
        for raw in texts:
            # The tokenizer folds case itself, but only after it has looked for special tokens.
            folded = (raw if b"<|" in raw else raw.lower()) if raw else b""
            out.append(b"".join(recent.lookup(folded.split(), make, CACHED_BYTES)) + end)
        return out

    return encode


def _ids(ids) -> bytes:
    return array("I", ids).tobytes()


_ENCODERS: dict[tuple, Encoder] = {}


def _id_lists(encoded: list[bytes]) -> pa.ListArray:
    sizes = np.fromiter((len(e) // 4 for e in encoded), np.int64, len(encoded))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(
        pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), "<i4"), pa.int32())
    )


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int | None = 1,
) -> None:
    """Encode every text and write the ids in ascending order of ``id_col``.

    The texts are dealt by ranges of ``(id, text hash)``, once, and encoded where they
    are sorted. A null text is empty and a row still gets its end id; null ids come first;
    rows with one id lie next to each other in the order of their text hashes.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (tokenizer, end_id)
        if key not in _ENCODERS:
            _ENCODERS[key] = chunk_encoder(tokenizer, end_id)
        part, pos = TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, "_text"):
                ids = _id_lists(_ENCODERS[key](raw_texts(batch.column("_text"))))
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, part), pa.int32()),
                        pa.array(np.arange(pos, pos + n), pa.int64()),
                        batch.column("_id"),
                        ids.value_lengths().cast(pa.int64()),
                        ids,
                    ],
                    names=["part", "pos", "doc_id", "n_tokens", "ids"],
                )
                pos += n

    text = F.col(text_col).cast("string")
    (
        docs.select(F.col(id_col).cast("bigint").alias("_id"), text.alias("_text"))
        .withColumn("_spread", F.xxhash64("_text"))
        .repartitionByRange("_id", "_spread")
        .sortWithinPartitions("_id", "_spread")
        .select("_id", "_text")
        .mapInArrow(encode, SCHEMA)
        .write.options(**FORMAT)
        .parquet(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files as a table; select columns and filter ``doc_id`` for a partial read."""
    return spark.read.schema(SCHEMA).parquet(path)


def with_start(files: DataFrame) -> DataFrame:
    """Add ``start``, the ids of all documents before a row, from the metadata columns.

    Lengths are summed inside each file part; what came before a part is a running
    total over one row per part.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    offsets = parts.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return (
        files.join(offsets, "part")
        .withColumn("start", F.col("_offset") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .drop("_offset")
    )


def with_checksum(files: DataFrame) -> DataFrame:
    """Replace ``ids`` by ``ids_crc32``: unsigned crc32 of the little-endian 32-bit ids."""

    def checksum(batch: pa.RecordBatch) -> list[list[int]]:
        ids = batch.column("ids")
        values = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")
        at = ids.offsets.to_numpy()
        return [[zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:])]]

    return append_columns(
        files, ["ids"], [StructField("ids_crc32", LongType())], checksum,
        keep=[c for c in files.columns if c != "ids"],
    )
