import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from convoweave.llm import oracle, queries
from llm_data import prose, varied


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language ID", "line dedup", "MinHash near-dedup", "benchmark decontamination", "SentencePiece encoding and decoding"
    ]
    registered = entry.queries()
    assert set(queries.QUERIES) <= set(registered) and "pipeline" in registered
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    relation = con.sql(oracle.ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    ours = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert ours == sorted(relation.select(*[f'"{c}"' for c in columns]).fetchall(), key=repr)


def test_each_stage_takes_effect(spark, tmp_path):
    item = prose(500, 40).replace("\n", " ")
    docs = [
        (1, prose(1, 120)), (2, None), (3, "!!!"), (4, "intro " + prose(1, 120)), (5, prose(2, 50) + "\n" + item + "\n" + prose(3, 50)),
        (6, prose(6, 90).replace("\n", " ")), (7, varied(prose(6, 90).replace("\n", " "), 1, 0.01)), (8, "head\n" + prose(8, 30).replace("\n", " ")), (9, "HEAD\n" + prose(9, 30).replace("\n", " ")),
    ]
    rows = [(k, t, "en", "s", None if t is None else len(t)) for k, t in docs]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "n_tokens", "restored"]
    found = {r.doc_id: r for r in out.collect()}
    assert {2, 3, 5} & set(found) == set()  # rejected language, benchmark passage
    assert {1, 6, 8, 9} <= set(found)
    assert found[9].text == dict(docs)[9].split("\n", 1)[1]  # the repeated head is cut
    for r in found.values():
        assert r.restored and r.n_chars == len(r.text) and r.n_tokens == len(r.ids)


def test_clean_documents_without_labels_stay(spark, tmp_path):
    rows = [(i, prose(50 + i, 80), None, "s", 1) for i in range(5)] + [(9, "12 34", None, "s", 5), (10, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(range(5))


def test_pipeline_on_a_table(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").cache()
    assert 0 < out.count() <= 200
    assert out.where("not restored").count() == 0
