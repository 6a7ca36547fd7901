"""Inputs that Spark derives from the given tables, for operators that need other shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoweave import assemble_messages
from convoweave.streaming.rows import stream_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same as a stream, be the table one file or a folder of files.

    A plain path has to be a folder for a stream, and a glob on file names misses the files inside one; braces match either.
    """
    return stream_table(spark, f"{sf_dir.rstrip('/')}/{{{name}.parquet}}", table(spark, sf_dir, name).schema)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumnRenamed("text", "content")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(conv_id, messages)``."""
    return assemble_messages(turns(spark, sf_dir), key="conv_id")


def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations up to their last answer; the rejected one repeats that answer."""
    answered = conversations(spark, sf_dir).withColumn(
        "messages",
        F.expr("slice(messages, 1, coalesce(array_max(transform(messages, "
               "(m, i) -> if(m.role = 'assistant', i + 1, 0))), 0))"),
    )
    last = F.element_at("messages", -1)
    prompt = F.slice("messages", 1, F.size("messages") - 1)
    answer = F.struct(
        F.lit("assistant").alias("role"),
        F.concat(last["content"], F.lit("\n"), last["content"]).alias("content"),
    )
    return (
        answered.where(F.size("messages") > 0)
        .select(
            "conv_id",
            "messages",
            F.col("messages").alias("chosen"),
            F.concat(prompt, F.array(answer)).alias("rejected"),
        )
    )


def damaged_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some contents missing, some system messages of an unknown role."""
    damaged = turns(spark, sf_dir).select(
        "conv_id",
        "turn",
        F.when((F.col("role") == "system") & (F.length("content") % 2 == 0), "tool")
        .otherwise(F.col("role"))
        .alias("role"),
        F.when(F.length("content") % 5 != 0, F.col("content")).alias("content"),
    )
    return assemble_messages(damaged, key="conv_id")


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file inventory ``(path, is_dir)``: one checkpoint per event, a run per user."""
    return listing_of(table(spark, sf_dir, "events"))


def listing_of(events: DataFrame, *keep: str) -> DataFrame:
    """The same from events as a table or a stream, with columns of theirs."""
    user, event = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    kind = F.when(F.col("user_id") % 3 == 0, "dpo").otherwise("sft")
    base = F.concat(F.lit("results/"), kind, F.lit("/run-"), user)
    checkpoint = F.concat(base, F.lit("/checkpoint-"), event)

    def entry(path, is_dir=False, when=None):
        row = F.struct(path.alias("path"), F.lit(is_dir).alias("is_dir"))
        return row if when is None else F.when(when, row)

    of_type = lambda name: F.col("event_type") == name
    entries = [
        entry(checkpoint, True),
        entry(F.concat(checkpoint, F.lit("/model.safetensors"))),
        entry(F.concat(checkpoint, F.lit("/optimizer.pt"))),
        entry(F.concat(checkpoint, F.lit("/latest")), when=of_type("error")),
        entry(F.concat(base, F.lit("/train_results.json")), when=F.col("event_id") % 100 == 0),
        entry(F.concat(base, F.lit("/weights-"), event, F.lit(".bin")), when=of_type("signup")),
        entry(F.concat(base, F.lit("/checkpoint-x"), event), True, of_type("click")),
        entry(F.concat(base, F.lit("/checkpoint-9"), event), when=of_type("view")),
        entry(
            F.concat(base, F.lit("/slurm/job-"), event, F.lit(".sh")),
            when=of_type("purchase") & (F.col("event_id") % 20 == 7),
        ),
        entry(
            F.concat(F.lit("recipes/dpo/run-"), user, F.lit(".sh")),
            when=F.col("event_id") % 50 == 0,
        ),
        entry(
            F.concat(F.lit("results/"), kind, F.lit("/.tmp-"), user, F.lit("/a.bin")),
            when=of_type("view"),
        ),
        entry(F.concat(F.lit("logs/"), event, F.lit(".txt"))),
    ]
    return (
        events.select(F.explode(F.array(*entries)).alias("entry"), *keep)
        .where(F.col("entry").isNotNull())
        .select("entry.*", *keep)
    )


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id").distinct()


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(run, config_json)``: half usable, the others odd in various ways, some missing."""
    user = F.col("user_id").cast("string")
    kind = F.when(F.col("user_id") % 3 == 0, "dpo").otherwise("sft")
    variant = F.col("user_id") % 10
    config = (
        F.when(variant <= 4, F.concat(F.lit('{"hub_model_id": " org/run-'), user, F.lit(' "}')))
        .when(variant == 5, F.lit('{"hub_model_id": 12}'))
        .when(variant == 6, F.lit('{"hub_model_id": '))
        .when(variant == 7, F.lit('{"hub_model_id": "   "}'))
        .otherwise(F.lit("[1, 2]"))
    )
    return (
        _users(spark, sf_dir)
        .where(variant != 9)
        .select(
            F.concat(F.lit("results/"), kind, F.lit("/run-"), user).alias("run"),
            config.alias("config_json"),
        )
    )


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _users(spark, sf_dir)
        .where(F.col("user_id") % 4 == 0)
        .select(F.concat(F.lit("org/run-"), F.col("user_id").cast("string")).alias("repo_id"))
    )
