"""What a corpus-wide table says about each word, brought to the texts that hold the word.

The table of distinct words grows with the corpus, so it is never broadcast, and the texts are
not exploded into one row per word either. Documents are dealt into blocks of a few
megabytes. Each block sends its distinct words to the table, by word, and gets back one row for
each, by block. Blocks are dealt by a hash of id and text and are numbered by the size of the corpus,
so a task holds one block of text and the words of it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import raw_texts, slices

BLOCK_BYTES = 8 << 20

Words = Callable[[bytes | None], list[bytes]]


def pack_blocks(docs: DataFrame, text_col: str, carried: Sequence[str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(block, payload)``, dealt by block: some documents of a block, ``carried`` and text, compressed.

    Reads the text once for its total length, which fixes the number of blocks.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    blocks = max(-(-total // block_bytes), 3 * spark.sparkContext.defaultParallelism)
    names = [f"c{i}" for i in range(len(carried))]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for whole in batches:
            for batch in slices(whole, "text"):
                block = batch.column("block")
                order = pa.compute.sort_indices(block)
                ordered = batch.take(order)
                numbers = ordered.column("block").to_pylist()
                rows = ordered.select([*names, "text"])
                found, payloads, start = [], [], 0
                for i in range(1, len(numbers) + 1):
                    if i == len(numbers) or numbers[i] != numbers[start]:
                        # A fresh copy: a slice would be written with the buffers of its parent.
                        part = rows.take(pa.array(range(start, i)))
                        sink = pa.BufferOutputStream()
                        with pa.ipc.new_stream(sink, part.schema, options=options) as writer:
                            writer.write_batch(part)
                        found.append(numbers[start])
                        payloads.append(sink.getvalue().to_pybytes())
                        start = i
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.int64()), pa.array(payloads, pa.binary())], names=["block", "payload"]
                )

    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.pmod(F.xxhash64(*carried, text), F.lit(blocks)).alias("block"),
        *[F.col(c).alias(n) for c, n in zip(carried, names)],
        text.alias("text"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.mapInArrow(pack, "block bigint, payload binary").repartition(parts, "block")


def unpack(payloads: pa.ChunkedArray | pa.Array, n_carried: int) -> tuple[list[list], list[bytes | None]]:
    """The carried columns and the texts of a block."""
    carried: list[list] = [[] for _ in range(n_carried)]
    texts: list[bytes | None] = []
    for payload in payloads:
        with pa.ipc.open_stream(payload.as_buffer()) as reader:
            for batch in reader:
                for k in range(n_carried):
                    carried[k] += batch.column(k).to_pylist()
                texts += raw_texts(batch.column(n_carried))
    return carried, texts


def block_vocabulary(texts: list[bytes | None], words: Words, longest: int) -> list[bytes]:
    """The distinct words of a block in a fixed order; ``longest`` bounds their bytes."""
    found: set[bytes] = set()
    for raw in texts:
        found.update(words(raw))
    return sorted(w for w in found if len(w) <= longest)


def block_words(
    packed: DataFrame, words: Words, n_carried: int, longest: int = 1 << 30, counted: int | None = None, spread: int = 1
) -> DataFrame:
    """``(block, i, word)``, dealt by word: word ``i`` of a block's vocabulary.

    With ``counted``, ``n`` counts its occurrences in the documents where that carried column is true.
    ``spread`` is how many times as many partitions there are as a shuffle has.
    """

    def collect(table: pa.Table) -> pa.Table:
        carried, texts = unpack(table.column("payload"), n_carried)
        counts: Counter[bytes] = Counter()
        others: list[bytes | None] = []
        for k, raw in enumerate(texts):
            if counted is not None and carried[counted][k]:
                counts.update(words(raw))
            else:
                others.append(raw)
        found = sorted({*block_vocabulary(others, words, longest), *(w for w in counts if len(w) <= longest)})
        return pa.table(
            {
                "block": pa.array([table.column("block")[0].as_py()] * len(found), pa.int64()),
                "i": pa.array(range(len(found)), pa.int32()),
                "word": pa.array(found, pa.binary()),
            }
            | ({} if counted is None else {"n": pa.array([counts[w] for w in found], pa.int64())})
        )

    parts = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        packed.groupBy("block")
        .applyInArrow(collect, "block bigint, i int, word binary" + ("" if counted is None else ", n bigint"))
        .repartition(parts * spread, "word")
    )


def finish_blocks(
    packed: DataFrame, answers: DataFrame, finish: Callable[[pa.Table, pa.Table], pa.Table], schema: str
) -> DataFrame:
    """Rows that ``finish`` makes of a block's payloads and of the answers for it, ``(block, i, ...)``."""
    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, schema)
