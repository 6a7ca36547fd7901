"""The row-local chain gives on a stream what it gives on a table."""

import pytest
from pyspark.sql import functions as F

import convoweave as cw
from __spark_entry__ import QUERIES
from convoweave.streaming.rows import run_available, stream_member, stream_table, stream_text

from plan_checks import MESSAGES

EOS = "</s>"


def test_stream_equals_batch(spark, chats, tmp_path):
    source = str(tmp_path / "in")
    df = chats(*[[("user", f"q{i}"), ("assistant", "a")] for i in range(50)], None, [], [("user", None)])
    df.repartition(5).write.parquet(source)
    member = cw.Member("chats", columns=["id", "messages"], rename_columns={"id": "key"},
                       transform={"n": "size(messages)"})
    stream = stream_table(spark, source, df.schema, max_files_per_trigger=2)
    run_available(
        stream_text(stream_member(stream, member), eos=EOS), str(tmp_path / "out"), str(tmp_path / "cp")
    )
    rows = {(r.key, r.n, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {(i, 2, f"<|user|>\nq{i}\n<|assistant|>\na</s>") for i in range(50)}


def test_what_needs_whole_tables_refuses_streams(spark, tmp_path):
    stream = stream_table(spark, str(tmp_path), spark.createDataFrame([], f"id long, messages {MESSAGES}").schema)
    with pytest.raises(ValueError):
        stream_member(stream, cw.Member("a", weight=0.5))
    with pytest.raises(ValueError):
        cw.train_test_split(stream, ["id"], test_size=0.5)
    with pytest.raises(ValueError):
        cw.pack(stream, ["id"], "id", block=4, shards=2)
    with pytest.raises(ValueError):
        cw.assemble_messages(stream, key="id")
    with pytest.raises(ValueError):
        cw.turn_spans(stream, eos=EOS, key="id")
    with pytest.raises(ValueError):
        stream_table(spark, str(tmp_path), stream.schema, format="avro")


@pytest.mark.parametrize("folder", [False, True])
@pytest.mark.parametrize("name,of", [("stream_documents", "documents"), ("stream_run_status", "events")])
def test_a_table_of_one_file_or_of_many(spark, sf_dir, tmp_path, name, of, folder):
    """``documents.parquet`` may be a folder of part files; a glob on file names missed all of them."""
    query = QUERIES[name]
    few = spark.read.parquet(f"{sf_dir}/{of}.parquet").limit(60)
    if folder:
        few.repartition(3).write.parquet(str(tmp_path / f"{of}.parquet"))
    else:
        few.coalesce(1).write.parquet(str(tmp_path / "one"))
        (file,) = (tmp_path / "one").glob("*.parquet")
        file.rename(tmp_path / f"{of}.parquet")
    rows = query(spark, str(tmp_path)).collect()
    assert len(rows) == (60 if of == "documents" else few.select("user_id").distinct().count())
