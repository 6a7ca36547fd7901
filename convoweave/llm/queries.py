"""One query per operator over the whole given tables, with production parameters."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from ..sources.scratch import scratch_path
from . import (
    alignment,
    decontamination,
    language_id,
    line_dedup,
    lm_scoring,
    merkle,
    near_dedup,
    neighbours,
    piece_encoding,
    repeats,
    token_counts,
    token_files,
    url_filters,
)

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id has the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


SITE_RULES = [
    url_filters.site_rule("com/", "allow"),
    url_filters.site_rule("example.com/en/", "block"),
    url_filters.site_rule("www.example.com/en/", "allow"),
    url_filters.site_rule("net/es/", "block"),
    url_filters.site_rule("net/fr/", "block"),
]
# Without a label, and below every site rule: hosts named like link farms.
SPAM_RULES = [url_filters.Rule(f"*{word}**", "block", None, -1) for word in ("spam", "casino", "viagra")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.filter_urls(pages, SITE_RULES + SPAM_RULES).drop("url")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", fold("doc_id", 4) == 2)
    model = language_id.fit_languages(docs.where(~F.col("held_out")))
    return language_id.predict_languages(docs, model, keep=["doc_id", "held_out"])


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = piece_encoding.encode_pieces(docs, PIECE_MODEL)
    return piece_encoding.decode_pieces(encoded, PIECE_MODEL).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.md5(F.array_join("ids", " ")).alias("ids_md5"),
        F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("restored"),
    )


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, WORD_TOKENIZER)
    files = token_files.with_checksum(token_files.read_token_files(spark, path))
    return token_files.with_start(files).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontamination.mark_benchmark(docs, table(spark, sf_dir, "benchmark"))
    return decontamination.with_contamination(marked.drop("text")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, PIECE_MODEL, keep=["doc_id"])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select(
        "doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_md5")
    )


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_scoring.score_texts(docs.withColumn("held_out", fold("doc_id", 5) == 1), "held_out")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align_corpus(docs, BYTE_TOKENIZER, PIECE_MODEL, keep=["doc_id"])


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    leaves = docs.select(
        "doc_id",
        "lang",
        merkle.row_digest([*fields, F.col("text")]).alias("leaf"),
        F.when(fold("doc_id", 3) == 0, merkle.row_digest([*fields, changed])).alias("changed"),
    )
    manifest = merkle.build_manifest(leaves, id_col="doc_id", group_col="lang", leaf_col="leaf")
    return merkle.prove_rows(manifest).select(
        "doc_id", "leaf", "subroot", "root",
        merkle.proof_digest(F.col("proof")).alias("proof_sha256"),
        merkle.fold_proof(F.coalesce("changed", "leaf"), F.col("proof")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id", "n_words", "n_removed",
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters,
        op2_language_id,
        op3_neighbours,
        op4_pieces,
        op5_token_files,
        op6_decontamination,
        op7_token_counts,
        op8_line_dedup,
        op9_near_dedup,
        op10_lm_scoring,
        op11_alignment,
        op12_manifest,
        op13_repeats,
    )
}
