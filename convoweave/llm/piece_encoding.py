"""SentencePiece encoding by a relational lattice, and decoding.

Words are segmented once each, wherever they occur (``word_blocks``). The lattice of a word
is a table: its substrings of bounded length, exploded, joined to the piece table, and
grouped by word again. Viterbi is a fold over the end positions of a word with Spark's
``aggregate``: what it keeps for each position is the best score and the ids that make it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .batches import append_columns
from .pieces import SPACE, Pieces, best_path, load_pieces, piece_table, piece_words
from .word_blocks import block_vocabulary, block_words, finish_blocks, pack_blocks, unpack

# Longer words, in bytes, get no rows of the lattice: the same dynamic program runs over them
# where their text is, with memory in proportion to their length.
LATTICE_BYTES = 96
# A partition's lattice is grouped in memory, some twenty edges a word, so words are dealt more finely than texts.
SPREAD = 8


def segment_words(words: DataFrame, pieces: Pieces, vocabulary: DataFrame) -> DataFrame:
    """``(word, ids)`` of the best segmentation of distinct words ``(word, text)``.

    The largest sum of scores wins, ties go to the longest last piece. A character
    without a piece becomes its bytes. The piece table is the vocabulary of one model,
    so it is broadcast. ``words`` keeps its partitioning, and nothing is shuffled.
    """
    ends = words.withColumn("length", F.length("text"))
    cut = (
        ends.select("word", "text", "length", F.expr("explode(sequence(1, length))").alias("e"))
        .select("word", "text", "length", "e", F.expr(f"explode(sequence(greatest(0, e - {pieces.longest}), e - 1))").alias("s"))
        .withColumn("part", F.expr("substring(text, s + 1, e - s)"))
    )
    byte_ids = F.array(*[F.lit(i) for i in pieces.byte_ids])
    of_bytes = F.transform(
        F.sequence(F.lit(1), F.octet_length("part")),
        lambda k: F.element_at(
            byte_ids, F.conv(F.hex(F.substring(F.encode("part", "UTF-8"), k, F.lit(1))), 16, 10).cast("int") + 1
        ),
    )
    edges = (
        cut.join(F.broadcast(vocabulary), F.col("part") == F.col("piece"), "left")
        .where(F.col("piece").isNotNull() | (F.col("e") - F.col("s") == 1))
        .select(
            "word",
            F.struct(
                "e",
                "s",
                F.coalesce("score", F.lit(pieces.unknown)).alias("score"),
                F.when(F.col("piece").isNotNull(), F.array("id")).otherwise(of_bytes).alias("ids"),
            ).alias("edge"),
        )
    )
    lattices = edges.groupBy("word").agg(F.collect_list("edge").alias("edges"))
    fold = """
        aggregate(
          sequence(1, array_max(edges.e)),
          array(struct(cast(0 as double) as score, 0 as back, cast(array() as array<int>) as ids)),
          (best, at) -> concat(best, array(array_max(transform(
            filter(edges, x -> x.e = at),
            x -> struct(best[x.s].score + x.score as score, -x.s as back, concat(best[x.s].ids, x.ids) as ids))))),
          best -> element_at(best, -1).ids)
    """
    return lattices.select("word", F.expr(fold).alias("ids"))


def encode_pieces(docs: DataFrame, model: str, *, text_col: str = "text", out: str = "ids") -> DataFrame:
    """Documents plus ``out``, the piece ids of each whole text.

    Null and empty texts have none. All columns come back, in any order of rows; a column
    named ``out`` is replaced. Rows that are equal in all columns lie in one block.
    """
    spark = docs.sparkSession
    pieces = load_pieces(model)
    carried = [c for c in docs.columns if c not in (text_col, out)]
    names = [f"_c{i}" for i in range(len(carried))]
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carried, names)], F.col(f"`{text_col}`").alias("_text"))
    packed = pack_blocks(plain, "_text", names)
    found = block_words(packed, piece_words, len(names), LATTICE_BYTES, spread=SPREAD)
    space = F.replace(F.col("word").cast("string"), F.lit(" "), F.lit(SPACE))
    # Reads all columns of the words as dealt, like the join below, so that both share one exchange.
    once = found.groupBy("word").agg(F.max("block").alias("b"), F.max("i").alias("i"))
    words = once.where("b is not null and i is not null").select("word").withColumn("text", space)
    answers = found.select("block", "i", "word").join(
        segment_words(words, pieces, piece_table(spark, pieces)), "word"
    ).select("block", "i", "ids")
    fields = [StructField(n, docs.schema[c].dataType) for n, c in zip(names, carried)]
    schema = StructType([*fields, StructField("_text", StringType()), StructField("_ids", ArrayType(IntegerType()))])
    arrow = _arrow_schema(schema)

    def finish(payloads: pa.Table, known: pa.Table) -> pa.Table:
        columns, texts = unpack(payloads.column("payload"), len(names))
        vocabulary = block_vocabulary(texts, piece_words, LATTICE_BYTES)
        lists = known.column("ids").combine_chunks()
        values = lists.values.to_numpy().astype("<i4")
        at = lists.offsets.to_numpy()
        ids_of = {
            vocabulary[i]: values[a:b].tobytes()
            for i, a, b in zip(known.column("i").to_pylist(), at[:-1].tolist(), at[1:].tolist())
        }
        model_ = load_pieces(model)
        encoded = []
        for raw in texts:
            words_ = piece_words(raw)
            for w in words_:
                if len(w) > LATTICE_BYTES and w not in ids_of:
                    text = w.decode("utf-8", "replace").replace(" ", SPACE)
                    ids_of[w] = np.array(best_path(text, model_), "<i4").tobytes()
            encoded.append(b"".join(map(ids_of.__getitem__, words_)))
        sizes = np.fromiter((len(e) // 4 for e in encoded), np.int64, len(encoded))
        ids = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)),
            pa.array(np.frombuffer(b"".join(encoded), "<i4"), pa.int32()),
        )
        text = pa.array(texts, pa.binary()).cast(pa.string())
        arrays = [pa.array(c, f.type) for c, f in zip(columns, arrow)] + [text, ids.cast(arrow.field("_ids").type)]
        return pa.Table.from_arrays(arrays, schema=arrow)

    done = finish_blocks(packed, answers, finish, schema)
    back = dict(zip(carried, names)) | {text_col: "_text"}
    return done.select(*[F.col(back[c]).alias(c) for c in docs.columns if c != out], F.col("_ids").alias(out))


def _arrow_schema(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def decode_pieces(encoded: DataFrame, model: str, *, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the text that ids stand for; encoding and decoding give the text back.

    A null list is a null text, an empty one an empty text. Control ids stand for nothing, ids outside
    the vocabulary raise an error, bytes that are no UTF-8 become replacement characters.
    """

    def decode(batch: pa.RecordBatch) -> list[list[str | None]]:
        texts = load_pieces(model).texts
        return [
            [
                None if ids is None else b"".join(map(texts.__getitem__, ids))[1:].decode("utf-8", "replace")
                for ids in batch.column(ids_col).to_pylist()
            ]
        ]

    return append_columns(encoded, [ids_col], [StructField(out, StringType())], decode)
