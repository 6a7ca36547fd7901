"""One query per operator, over whole tables."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import convoweave as cw
from convoweave.functions.chat import ROLE_MARKERS
from convoweave.functions.globs import table_patterns
from convoweave.functions.keys import row_key, stage_digest
from convoweave.operators import catalogue
from convoweave.plans.training_text import split_invalid
from convoweave.sources.listing import run_configs, run_entries
from convoweave.sources.scratch import scratch_path
from convoweave.streaming.runs import current_runs, stream_runs
from convoweave.streaming.rows import run_available, stream_member, stream_text

from . import inputs
from .inputs import table

EOS = "</s>"
SEED = 42
ONE_MESSAGE = {"messages": "array(struct('user' AS role, content AS content))"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# --- rendering -------------------------------------------------------------


@query
def render_chat(spark, sf_dir):
    return inputs.conversations(spark, sf_dir).select(
        "conv_id", cw.render_chat(F.col("messages"), EOS).alias("text")
    )


@query
def render_generation_prompt(spark, sf_dir):
    return inputs.conversations(spark, sf_dir).select(
        "conv_id",
        cw.render_chat(F.col("messages"), EOS, add_generation_prompt=True).alias("text"),
    )


@query
def render_guard(spark, sf_dir):
    valid, rejects = split_invalid(inputs.damaged_conversations(spark, sf_dir), ["messages"])
    text = cw.render_chat(F.col("messages"), EOS)
    return valid.select("conv_id", F.lit(False).alias("rejected"), text.alias("text")).unionAll(
        rejects.select("conv_id", F.lit(True).alias("rejected"), text.alias("text"))
    )


@query
def render_pairs(spark, sf_dir):
    pairs = cw.render_pairs(inputs.preference_pairs(spark, sf_dir), EOS)
    return pairs.select("conv_id", "chosen_text", "rejected_text")


@query
def assistant_spans(spark, sf_dir):
    return (
        inputs.conversations(spark, sf_dir)
        .select("conv_id", F.posexplode(cw.assistant_spans(F.col("messages"), EOS)))
        .select(
            "conv_id",
            F.col("pos").alias("span_no"),
            F.col("col.start").alias("span_start"),
            F.col("col.end").alias("span_end"),
        )
    )


@query
def render_turns(spark, sf_dir):
    return cw.render_turns(inputs.turns(spark, sf_dir), eos=EOS, key="conv_id").select(
        "conv_id", "turn", "piece", F.col("start").alias("piece_start")
    )


@query
def turn_spans(spark, sf_dir):
    return cw.turn_spans(inputs.turns(spark, sf_dir), eos=EOS, key="conv_id").select(
        "conv_id", "turn", F.col("start").alias("span_start"), F.col("end").alias("span_end")
    )


# --- scans, projections, filters -------------------------------------------


@query
def scan_dataset(spark, sf_dir):
    return cw.load_dataset(spark, "documents.parquet", root=sf_dir)["train"]


@query
def scan_splits(spark, sf_dir):
    splits = cw.load_dataset(spark, "documents.parquet", root=sf_dir, split_column="lang")
    frames = [df.select(F.lit(name).alias("split"), "doc_id") for name, df in splits.items()]
    return cw.concat_members(frames)


@query
def scan_member_split(spark, sf_dir):
    member = cw.Member("documents.parquet", split="fr", split_column="lang")
    return cw.load_member(spark, member, sf_dir)


@query
def select_rename(spark, sf_dir):
    member = cw.Member(
        "documents.parquet",
        columns=["doc_id", "text", "source"],
        rename_columns={"text": "content", "content": "body", "source": "origin"},
        final_columns=["doc_id", "body"],
    )
    return stream_member(cw.load_member(spark, member, sf_dir), member)


@query
def sft_columns(spark, sf_dir):
    chats = inputs.conversations(spark, sf_dir).withColumn("n", F.size("messages"))
    return cw.task_columns(chats, "sft", ("conv_id",)).select(
        "conv_id", F.size("messages").alias("n_messages")
    )


@query
def preference_columns(spark, sf_dir):
    pairs = cw.drop_messages({"train": inputs.preference_pairs(spark, sf_dir)})["train"]
    # Every column that is left shows, so a ``messages`` column that stayed would too.
    sizes = [F.size(c).alias(f"{c}_messages") for c in pairs.columns if c != "conv_id"]
    kept = cw.task_columns(pairs, "preference", ("conv_id",))
    return pairs.select("conv_id", *sizes).join(kept.select("conv_id"), "conv_id")


@query
def drop_empty_conversations(spark, sf_dir):
    answers = inputs.conversations(spark, sf_dir).withColumn(
        "messages", F.filter("messages", lambda m: m["role"] == "assistant")
    )
    return cw.drop_empty_conversations(answers).select(
        "conv_id", F.size("messages").alias("n_messages")
    )


@query
def concat_members(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.lit("doc").alias("src"), F.col("doc_id").alias("id"), "text", "lang"
    )
    bench = table(spark, sf_dir, "benchmark").select(
        "text", F.lit("bench").alias("src"), F.col("item_id").alias("id")
    )
    return cw.concat_members([docs, bench])


@query
def concat_nested(spark, sf_dir):
    """Conversations, documents and items whose messages have different fields, united and taken apart."""
    chats = inputs.conversations(spark, sf_dir).select(
        F.lit("conv").alias("src"), F.col("conv_id").cast("string").alias("id"), "messages"
    )
    docs = table(spark, sf_dir, "documents").select(
        F.lit("doc").alias("src"),
        F.col("doc_id").cast("string").alias("id"),
        F.array(
            F.struct(F.col("text").alias("content"), F.struct("lang", "n_chars").alias("meta"), F.lit("user").alias("role"))
        ).alias("messages"),
    )
    items = table(spark, sf_dir, "benchmark").select(
        F.array(F.struct(F.struct(F.col("item_id").alias("item")).alias("meta"), F.col("text").alias("content"))).alias("messages"),
        F.lit("bench").alias("src"),
    )
    united = cw.concat_nested([chats, docs, items])
    said = united.select("src", "id", F.inline("messages"))
    return said.select("src", "id", "role", "content", "meta.lang", "meta.n_chars", "meta.item")


@query
def transform_expressions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return cw.apply_transform(
        docs, {"lang": "upper(lang)", "n_words": "regexp_count(text, '[^ \\n]+')"}
    ).drop("text")


@query
def transform_batches(spark, sf_dir):
    def longer(batch):
        out = batch.assign(n_chars=batch["n_chars"] + 1, labelled=batch["lang"] + ":" + batch["source"])
        return out.sort_values("n_chars")  # rows are matched by index

    # A column that is only carried: large whole numbers beside nulls.
    large = F.expr("if(doc_id % 3 = 0, null, 9007199254740993 + doc_id)").alias("large")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", large)
    return cw.apply_transform(docs, cw.BatchTransform(longer, "n_chars bigint, labelled string"))


@query
def transform_columns(spark, sf_dir):
    """Columns by Arrow functions; the filter and the projection around them reach the scan."""
    import pyarrow.compute as pc

    joined = cw.ArrowColumn(lambda lang, source: pc.binary_join_element_wise(lang, source, ":"), "string", ["lang", "source"])
    longer = cw.ArrowColumn(lambda n: pc.add(n, 1), "bigint", ["n_chars"])
    unused = cw.ArrowColumn(lambda t: pc.utf8_upper(t), "string", ["text"])
    docs = cw.apply_transform(
        table(spark, sf_dir, "documents"), cw.ColumnTransform({"labelled": joined, "n_chars": longer, "loud": unused})
    )
    return docs.where((F.col("doc_id") >= 10) & (F.col("lang") != "de")).select("doc_id", "labelled", "n_chars")


@query
def replaced_split(spark, sf_dir):
    """A table of splits after one of them was written anew."""
    path = scratch_path(spark, "splits")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    cw.write_splits({"train": docs.where("doc_id % 5 <> 0"), "test": docs.where("doc_id % 5 = 0")}, path)
    cw.write_splits({"test": docs.where("doc_id % 10 = 0")}, path, mode="overwrite_splits")
    return spark.read.schema("doc_id bigint, lang string, split string").parquet(path)


@query
def transform_rows(spark, sf_dir):
    def decomposed(row):
        # Unicode normalisation has no built-in form.
        return {"n_letters": len(unicodedata.normalize("NFD", row["text"]))}

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return cw.apply_transform(docs, cw.RowTransform(decomposed, "n_letters bigint")).drop("text")


# --- exact sampling, order, split ------------------------------------------


@query
def sample_by_weight(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return cw.exact_sample(docs, ["doc_id"], fraction=0.66, seed=SEED, member="doc")


@query
def sample_by_row_weight(spark, sf_dir):
    """A fifth of the documents, good ones four times as likely, unlabelled ones twice, bad ones with id 7 mod 11 never."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang").join(labels, "doc_id", "left")
    weight = F.coalesce(1.0 + 3.0 * F.col("quality"), F.lit(2.0))
    weighted = docs.withColumn("weight", F.when((F.col("doc_id") % 11 == 7) & (F.col("quality") == 0), 0.0).otherwise(weight))
    return cw.weighted_sample(weighted, ["doc_id"], "weight", fraction=0.2, seed=SEED, member="doc")


@query
def sample_composite_key(spark, sf_dir):
    """Lines of one order may share a number; the cut may fall between them."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return cw.exact_sample(
        lines, ["l_orderkey", "l_linenumber"], fraction=0.29, seed=SEED, member="line", by_content=True
    )


@query
def sample_without_key(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("text", F.expr("nullif(source, 'src0')").alias("source"))
    texts = cw.with_content_key(docs, "content_key")
    kept = cw.exact_sample(texts, ["content_key"], fraction=0.5, seed=SEED, member="doc")
    return kept.select("content_key", F.length("text").alias("n_chars"))


@query
def shuffle_order(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    key = stage_digest(SEED, "shuffle", "doc", row_key(["doc_id"]))
    return docs.select("doc_id", key.alias("order_key"))


@query
def permuted_order(spark, sf_dir):
    """Place of every document in a shuffled order, without a sort by it, and what the place leads back to."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    numbered, n = cw.number_rows(docs, ["doc_id"])
    order = cw.Permutation(n, SEED)
    placed = numbered.withColumn("place", order.place(F.col("_number")))
    return placed.select("doc_id", F.col("_number").alias("number"), "place", order.item(F.col("place")).alias("back"))


@query
def sample_by_place(spark, sf_dir):
    """An exact sample as a filter on places."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return cw.sample_rows(docs, ["doc_id"], fraction=0.3, seed=SEED)


@query
def train_test_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    splits = cw.train_test_split(docs, ["doc_id"], test_size=0.07, seed=SEED, member="doc")
    return splits["train"].withColumn("split", F.lit("train")).unionAll(
        splits["test"].withColumn("split", F.lit("test"))
    )


# --- mixture ---------------------------------------------------------------


def _mixture_plan(spark, sf_dir):
    mixture = cw.Mixture.from_dict(
        {
            "datasets": [
                {
                    "id": "conv",
                    "weight": 0.5,
                    "key": ["conv_id"],
                    "columns": ["messages"],
                },
                {
                    "id": "doc",
                    "weight": 0.66,
                    "key": ["doc_id"],
                    "columns": ["text"],
                    "rename_columns": {"text": "content"},
                    "transform": ONE_MESSAGE,
                    "final_columns": ["messages"],
                },
                {
                    "id": "bench",
                    "weight": 0.10,
                    "key": ["item_id"],
                    "columns": ["text"],
                    "rename_columns": {"text": "content"},
                    "transform": ONE_MESSAGE,
                    "final_columns": ["messages"],
                },
            ],
            "seed": SEED,
            "test_split_size": 0.1,
        }
    )
    tables = {
        "conv": inputs.conversations(spark, sf_dir),
        "doc": table(spark, sf_dir, "documents"),
        "bench": table(spark, sf_dir, "benchmark"),
    }
    return cw.plan_mixture(spark, mixture, tables=tables)


@query
def mixture(spark, sf_dir):
    return _mixture_plan(spark, sf_dir).frame.select(
        F.col("_member").alias("member"),
        F.col("_row_key").alias("row_key"),
        F.col("_order_key").alias("order_key"),
        "split",
        cw.render_chat(F.col("messages"), EOS).alias("text"),
    )


@query
def mixture_without_keys(spark, sf_dir):
    """Members without key columns and without weight; no test split."""
    keyless = {"columns": ["text"]}
    mixture = cw.Mixture.from_dict(
        {
            "datasets": [
                {"id": "documents.parquet", "weight": 0.5, **keyless},
                {"id": "benchmark.parquet", **keyless},
                {"id": "conversations.parquet", "weight": None, **keyless},
            ],
            "seed": SEED,
        }
    )
    frame = cw.build_mixture(spark, mixture, sf_dir)["train"]
    return frame.select(
        F.col("_member").alias("member"),
        F.col("_row_key").alias("row_key"),
        F.col("_order_key").alias("order_key"),
        F.length("text").alias("n_chars"),
    )


@query
def mixture_counts(spark, sf_dir):
    return _mixture_plan(spark, sf_dir).counts()


@query
def split_counts(spark, sf_dir):
    return cw.split_counts(_mixture_plan(spark, sf_dir).splits)


@query
def write_splits(spark, sf_dir):
    """Written in shuffled order, then read back with the place of each row in its file."""
    path = scratch_path(spark, "mixture")
    _mixture_plan(spark, sf_dir).write(path)
    return spark.read.parquet(path).select(
        F.col("_member").alias("member"),
        F.col("_row_key").alias("row_key"),
        F.col("_order_key").alias("order_key"),
        F.col("split").cast("string").alias("split"),
    )


@query
def split_metrics(spark, sf_dir):
    """``train_samples`` and ``eval_samples`` as written, read back."""
    path = scratch_path(spark, "metrics")
    cw.write_metrics(cw.split_counts(_mixture_plan(spark, sf_dir).frame), path)
    return spark.read.schema("train_samples bigint, eval_samples bigint").json(path)


@query
def written_metrics(spark, sf_dir):
    """The same counts, taken while the splits are written."""
    path = scratch_path(spark, "mixture")
    _mixture_plan(spark, sf_dir).write(path, metrics=f"{path}-metrics")
    return spark.read.schema("train_samples bigint, eval_samples bigint").json(f"{path}-metrics")


# --- tokens ----------------------------------------------------------------


@query
def token_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", cw.token_count(F.col("text"), EOS).alias("n_tokens")
    )


@query
def chat_token_counts(spark, sf_dir):
    """Summed over turns: no token reaches across two pieces, so nothing is gathered."""
    pieces = cw.render_turns(inputs.turns(spark, sf_dir), eos=EOS, key="conv_id")
    return pieces.groupBy("conv_id").agg(
        F.sum(cw.token_count(F.col("piece"), EOS)).cast("int").alias("n_tokens")
    )


@query
def truncate_tokens(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return cw.truncate_tokens(docs, 4096, eos=EOS).select(
        "doc_id", "n_tokens", "truncated", F.array_join("tokens", " ").alias("kept")
    )


@query
def pack_in_key_order(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return cw.pack(
        docs, ["doc_id"], "n_chars", block=4096, shards=8,
        order="doc_id", shard=F.col("doc_id") % 8,
    )


@query
def pack_segments(spark, sf_dir):
    placed = pack_in_key_order(spark, sf_dir)
    return cw.pack_segments(placed, "n_chars", block=4096).select(
        "doc_id", "shard", "block", "offset",
        F.col("from").alias("from_char"), F.col("to").alias("to_char"),
    )


@query
def pack_in_hash_order(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", cw.token_count(F.col("text"), EOS).alias("n_tokens")
    )
    return cw.pack(docs, ["doc_id"], "n_tokens", block=4096, shards=8, seed=SEED, materialise=True)


@query
def packed_text(spark, sf_dir):
    text = cw.sft_text(inputs.conversations(spark, sf_dir), eos=EOS, keep=["conv_id"])
    blocks = cw.packed_text(text, ["conv_id"], block=512, shards=4, seed=SEED)
    return blocks.select(
        "shard",
        "block",
        F.size("tokens").alias("n_tokens"),
        F.array_join("tokens", " ").alias("text"),
    )


@query
def pack_whole_rows(spark, sf_dir):
    """Per document: its pieces, and whether they lie inside their blocks without touching others."""
    docs = table(spark, sf_dir, "documents").select("doc_id", cw.token_count(F.col("text"), EOS).alias("n_tokens"))
    placed = cw.pack_whole(docs, ["doc_id"], "n_tokens", block=4096, seed=SEED, materialise=True)
    size = F.col("to") - F.col("from")
    after = F.lead("offset").over(Window.partitionBy("block").orderBy("offset"))
    room = F.coalesce(after, F.lit(4096)) - F.col("offset")
    return placed.withColumn("_apart", room >= size).groupBy("doc_id", "n_tokens").agg(
        F.count(F.lit(1)).alias("n_pieces"),
        F.sum(size).alias("n_placed"),
        F.max(size).cast("int").alias("longest"),
        F.every("_apart").alias("apart"),
    )


@query
def packed_whole_text(spark, sf_dir):
    """Blocks of whole conversations, cut again where the lengths say."""
    text = cw.sft_text(inputs.conversations(spark, sf_dir), eos=EOS, keep=["conv_id"])
    blocks = cw.packed_text(text, ["conv_id"], block=512, seed=SEED, whole_rows=True)
    start = F.aggregate(F.slice("lengths", F.lit(1), F.col("i")), F.lit(0), lambda a, n: a + n)
    rows = blocks.select("tokens", "lengths", F.posexplode("lengths").alias("i", "n_tokens"))
    return rows.select("n_tokens", F.array_join(F.slice("tokens", start + 1, F.col("n_tokens")), " ").alias("text"))


def _digits(mask):
    return F.array_join(F.transform(mask, lambda flag: flag.cast("int").cast("string")), "")


@query
def packed_masked_text(spark, sf_dir):
    text = cw.sft_text(inputs.conversations(spark, sf_dir), eos=EOS, keep=["conv_id"], masked=True)
    blocks = cw.packed_text(text, ["conv_id"], block=512, shards=4, seed=SEED)
    return blocks.select(
        "shard", "block", F.array_join("tokens", " ").alias("text"), _digits(F.col("mask")).alias("mask")
    )


@query
def token_mask(spark, sf_dir):
    text = cw.sft_text(
        inputs.conversations(spark, sf_dir), eos=EOS, keep=["conv_id"], masked=True, max_length=256
    )
    return text.rows.select("conv_id", _digits(F.col("mask")).alias("mask"))


def _byte_tokenizer():
    """A public tokenizer with the role markers and the end of sequence as atoms."""
    import public_tokenizers

    encoder = cw.FileTokenizer(public_tokenizers.path("byte_bpe_50k.json"), (*ROLE_MARKERS.values(), EOS))
    return encoder, cw.OffsetTokenizer(encoder)


@query
def masked_token_ids(spark, sf_dir):
    """What the ids of a trained tokenizer, and those of them that are trained on, say."""
    encoder, tokenizer = _byte_tokenizer()
    chats = inputs.conversations(spark, sf_dir)
    rows = cw.sft_text(chats, eos=EOS, keep=["conv_id"], masked=True, tokenizer=tokenizer).rows
    decode = cw.token_decoder(encoder.decode)
    trained = F.transform(F.filter(F.arrays_zip("tokens", "mask"), lambda t: t["mask"]), lambda t: t["tokens"])
    return rows.select(
        "conv_id",
        (F.size("tokens") == F.size("mask")).alias("complete"),
        F.md5(decode(F.col("tokens"))).alias("text_md5"),
        F.md5(decode(trained)).alias("trained_md5"),
    )


@query
def packed_token_ids(spark, sf_dir):
    """Blocks of ids with their masks: how many of each, and a checksum over both."""
    _, tokenizer = _byte_tokenizer()
    chats = inputs.conversations(spark, sf_dir)
    text = cw.sft_text(chats, eos=EOS, keep=["conv_id"], masked=True, tokenizer=tokenizer)
    blocks = cw.packed_text(text, ["conv_id"], block=2048, shards=4, seed=SEED)
    return blocks.select(
        "shard", "block", F.size("tokens").alias("n_tokens"),
        F.size(F.filter("mask", lambda flag: flag)).alias("n_trained"),
        F.md5(F.concat_ws(":", F.array_join("tokens", " "), _digits(F.col("mask")))).alias("blocks_md5"),
    )


@query
def sft_text(spark, sf_dir):
    text = cw.sft_text(
        inputs.damaged_conversations(spark, sf_dir), eos=EOS, keep=["conv_id"],
        masked=True, max_length=256,
    )
    return text.rows.select(
        "conv_id",
        "text",
        "n_tokens",
        "truncated",
        F.array_join("tokens", " ").alias("kept"),
        F.size("spans").alias("n_spans"),
        F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"]).alias(
            "trainable_chars"
        ),
    )


@query
def preference_text(spark, sf_dir):
    text = cw.preference_text(
        inputs.preference_pairs(spark, sf_dir), eos=EOS, keep=["conv_id"], max_length=512
    )
    return text.rows.select(
        "conv_id",
        "chosen_text",
        "rejected_text",
        "chosen_n_tokens",
        "rejected_n_tokens",
        "chosen_truncated",
        "rejected_truncated",
    )


# --- run catalogue ---------------------------------------------------------


def _runs(spark, sf_dir, *, with_published=True):
    return cw.run_status(
        inputs.listing(spark, sf_dir),
        inputs.configs(spark, sf_dir),
        inputs.published(spark, sf_dir) if with_published else None,
    )


def _entries(spark, sf_dir):
    return run_entries(inputs.listing(spark, sf_dir))


@query
def run_status(spark, sf_dir):
    return _runs(spark, sf_dir)


@query
def run_status_unchecked(spark, sf_dir):
    return _runs(spark, sf_dir, with_published=False).select("path", "published_status")


@query
def listing_entries(spark, sf_dir):
    return _entries(spark, sf_dir).where(~F.col("is_override")).select(
        "kind", "run", "path", "is_dir"
    )


@query
def config_hub_ids(spark, sf_dir):
    return run_configs(inputs.configs(spark, sf_dir))


@query
def latest_checkpoint(spark, sf_dir):
    return catalogue.summarise_runs(_entries(spark, sf_dir)).select(
        "path", "latest_checkpoint_step"
    )


@query
def run_scripts(spark, sf_dir):
    return catalogue.summarise_runs(_entries(spark, sf_dir)).select(
        "path", "slurm_script", "many_scripts"
    )


@query
def finished_runs(spark, sf_dir):
    runs = catalogue.summarise_runs(_entries(spark, sf_dir)).select("path", "kind")
    return catalogue.finished_runs(runs, inputs.listing(spark, sf_dir))


@query
def publishable_runs(spark, sf_dir):
    return catalogue.publishable(_runs(spark, sf_dir, with_published=False)).select(
        "path", "hub_model_id"
    )


@query
def resubmittable_runs(spark, sf_dir):
    return catalogue.resubmittable(_runs(spark, sf_dir, with_published=False)).select(
        "path", "slurm_script"
    )


@query
def exclude_finished(spark, sf_dir):
    return catalogue.exclude_finished(_runs(spark, sf_dir, with_published=False)).select(
        "path", "submit_status"
    )


@query
def exclude_published(spark, sf_dir):
    runs = _runs(spark, sf_dir, with_published=False)
    return catalogue.exclude_published(runs, inputs.published(spark, sf_dir)).select(
        "path", "hub_model_id"
    )


@query
def catalogue_counts(spark, sf_dir):
    return catalogue.catalogue_counts(_runs(spark, sf_dir))


@query
def listing_order(spark, sf_dir):
    return catalogue.in_listing_order(_runs(spark, sf_dir, with_published=False)).select(
        "kind", "run", "submit_status"
    )


@query
def artifact_manifest(spark, sf_dir):
    return catalogue.artifact_manifest(_entries(spark, sf_dir))


@query
def upload_manifest(spark, sf_dir):
    return catalogue.upload_manifest(
        _entries(spark, sf_dir), _runs(spark, sf_dir, with_published=False)
    )


@query
def bucketed_catalogue(spark, sf_dir):
    """Runs with their ids and markers, joined bucket by bucket."""
    listing = inputs.listing(spark, sf_dir)
    runs = cw.keep_by_path(catalogue.summarise_runs(run_entries(listing)), buckets=8)
    configs = cw.keep_by_path(run_configs(inputs.configs(spark, sf_dir)), column="run", buckets=8)
    return catalogue.attach_hub_ids(runs, configs).select("path", "finished", "latest_checkpoint_step", "hub_model_id")


# Globs with every kind of part; the twin has the same ones.
UPLOAD_PATTERNS = {
    "ignore": ["checkpoint-*[!05]/*", "slurm/job-?.sh", "*/[k-o]*.pt", "weights-*1*.bin"],
    "allow": ["*.bin", "*.pt", "checkpoint-*/[a-m]*", "slurm/**"],
}


@query
def upload_by_patterns(spark, sf_dir):
    """Ignored and allowed files by tables of patterns."""
    rules = spark.createDataFrame([(k, p) for k, ps in UPLOAD_PATTERNS.items() for p in ps], "kind string, pattern string")
    lists = {kind: table_patterns(rules.where(F.col("kind") == kind)) for kind in UPLOAD_PATTERNS}
    return catalogue.upload_manifest(_entries(spark, sf_dir), _runs(spark, sf_dir, with_published=False), **lists)


# --- streaming -------------------------------------------------------------


@query
def stream_run_status(spark, sf_dir):
    """Runs as a stream of file entries leaves them, once the source is drained."""
    events = inputs.table_stream(spark, sf_dir, "events")
    path = scratch_path(spark, "stream")
    updates = stream_runs(inputs.listing_of(events, "ts"), repeats_within="400 days")
    run_available(updates, f"{path}/data", f"{path}/state")
    return current_runs(spark, f"{path}/data").drop("last_new")


@query
def stream_documents(spark, sf_dir):
    """The row-local chain on a file stream, run until the source is drained."""
    member = cw.Member(
        "documents",
        columns=["doc_id", "text"],
        rename_columns={"text": "content"},
        transform=ONE_MESSAGE,
        final_columns=["doc_id", "messages"],
    )
    stream = inputs.table_stream(spark, sf_dir, "documents")
    path = scratch_path(spark, "stream")
    run_available(
        stream_text(stream_member(stream, member), eos=EOS), f"{path}/data", f"{path}/state"
    )
    return spark.read.schema("doc_id bigint, text string").parquet(f"{path}/data")
