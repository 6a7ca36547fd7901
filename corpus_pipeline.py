"""The corpus pipeline: documents in, cleaned and encoded documents out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoweave.llm import decontamination, language_id, line_dedup, near_dedup, piece_encoding
from convoweave.llm.queries import PIECE_MODEL, table
from convoweave.sources.scratch import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language is rejected; learns from their own labels."""
    return language_id.keep_identified(docs, language_id.fit_languages(docs))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that nearly equal an earlier line out of the texts; no document goes.

    ``n_chars`` follows the text. A document all of whose lines came before is left with an empty text.
    """
    cut = line_dedup.dedup_lines(docs).drop("n_lines", "n_removed")
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words, similarity 0.8."""
    return near_dedup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the piece ids, their number, and whether decoding them gives the text back."""
    encoded = piece_encoding.encode_pieces(docs, PIECE_MODEL)
    decoded = piece_encoding.decode_pieces(encoded, PIECE_MODEL)
    return decoded.select(
        *docs.columns,
        "ids",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("restored"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("language ID", identify_language),
    ("line dedup", cut_repeated_lines),
    ("MinHash near-dedup", drop_copies),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece encoding and decoding", encode),
]

# Language ID, fuzzy lines and piece encoding have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each over what the former wrote."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = scratch_path(spark, "stage")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
