"""Every registered query against its SQL twin, and golden counts."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from plan_checks import plan_text
from convoweave_queries import oracle, spark_queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES, ORACLE = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


# What SQL has no form for; compared with plain Python in the tests of the operators.
NO_TWIN = {"packed_token_ids"}


def test_every_query_has_a_twin():
    assert set(spark_queries.QUERIES) == set(oracle.ORACLE) | NO_TWIN
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    relation = duck.sql(ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    ours = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    theirs = sorted(relation.select(*[f'"{c}"' for c in columns]).fetchall(), key=repr)
    assert ours == theirs


def test_entry_yields_rows(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["conv_id", "text"] and df.count() == 20


def test_golden_mixture_counts(spark, sf_dir):
    rows = {(r.member, r.split): r.rows for r in QUERIES["mixture_counts"](spark, sf_dir).collect()}
    assert rows == {
        ("conv", "test"): 2, ("doc", "test"): 13,
        ("conv", "train"): 8, ("doc", "train"): 119, ("bench", "train"): 4,
    }


def test_golden_block_count(spark):
    rows = QUERIES["pack_in_key_order"](spark, "/root/testdata/sf0.01")
    assert rows.select("shard", "block").distinct().count() == 453


@pytest.mark.parametrize("name", ["mixture", "sft_text", "pack_in_key_order", "turn_spans", "run_status"])
def test_no_window_over_a_whole_table(spark, sf_dir, name):
    assert "SinglePartition" not in plan_text(QUERIES[name](spark, sf_dir))


def test_token_count_scans_two_columns(spark, sf_dir):
    plan = plan_text(QUERIES["token_counts"](spark, sf_dir))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_split_filter_reaches_the_scan(spark, sf_dir):
    assert "EqualTo(lang,fr)" in plan_text(QUERIES["scan_member_split"](spark, sf_dir))
