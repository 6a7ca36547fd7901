"""Run catalogue on inline listings with the odd cases."""

import pytest
from pyspark.sql import functions as F

import convoweave as cw
from convoweave.functions.status import hub_id
from convoweave.operators import catalogue
from convoweave.operators.skew import salted_join
from convoweave.sources.listing import run_entries, scan_configs

DIRS = [
    "results/sft/a",
    "results/sft/a/checkpoint-10",
    "results/sft/a/checkpoint-9",
    "results/sft/a/checkpoint-x",
    "results/sft/a/checkpoint-",
    "results/sft/a/checkpoint-12b",
    "results/sft/B",
    "results/sft/.hidden",
    "results/sft/b2/train_results.json",  # a directory of that name does not count
    "results/dpo/d",
    "results/other/z",
]
FILES = [
    "results/sft/a/checkpoint-99",
    "results/sft/a/sub/train_results.json",
    "results/sft/a/checkpoint-10/model.safetensors",
    "results/sft/a/checkpoint-10/optimizer.pt",
    "results/sft/a/checkpoint-10/latest",
    "results/sft/a/checkpoint-10/xlatest",
    "results/sft/a/checkpoint-10/a.jsonl",
    "results/sft/a/checkpoint-10/deep/x.json",
    "results/sft/B/train_results.json",
    "results/sft/B/slurm/2.sh",
    "results/sft/B/slurm/10.sh",
    "results/sft/B/slurm/more/0.sh",
    "results/sft/B/slurm/notes.txt",
    "results/sft/B/weights.bin",
    "results/sft/plain_file",
    "results/dpo/d/slurm/own.sh",
    "results/dpo/d/train_results.json",
    "recipes/dpo/d.sh",
    "recipes/dpo/gone.sh",
    "recipes/dpo/sub/d.sh",
    "elsewhere/file",
]
CONFIGS = [
    ("results/sft/a", '{"hub_model_id": " org/a\\t"}'),
    ("results/sft/B", '{"hub_model_id": "org/b"}'),
    ("results/dpo/d", '{"hub_model_id": 12}'),
]


@pytest.fixture(scope="module")
def listing(spark):
    rows = [(p, True) for p in DIRS] + [(p, False) for p in FILES]
    return spark.createDataFrame(rows, "path string, is_dir boolean")


@pytest.fixture(scope="module")
def configs(spark):
    return spark.createDataFrame(CONFIGS, "run string, config_json string")


@pytest.fixture(scope="module")
def published(spark):
    return spark.createDataFrame([("org/b",), ("org/b",), (None,)], "repo_id string")


@pytest.fixture(scope="module")
def status(listing, configs, published):
    return cw.run_status(listing, configs, published)


def test_status_of_each_run(status):
    rows = {r.path: r for r in status.collect()}
    assert set(rows) == {"results/sft/a", "results/sft/B", "results/sft/b2", "results/dpo/d"}
    a, b, d = (rows[f"results/{p}"] for p in ("sft/a", "sft/B", "dpo/d"))
    assert (a.finished, a.latest_checkpoint_step, a.slurm_script) == (False, 10, None)
    assert a.finish_reason == "missing train_results.json (training not finished or failed)"
    assert (a.submit_status, a.publish_status, a.published_status) == ("in progress", "not finished", "no")
    assert (b.finished, b.slurm_script, b.many_scripts) == (True, "results/sft/B/slurm/10.sh", True)
    assert b.finish_reason == "found train_results.json"
    assert (b.submit_status, b.publish_status, b.published_status) == ("finished", "ready", "yes")
    assert (d.slurm_script, d.many_scripts, d.hub_model_id) == ("recipes/dpo/d.sh", False, None)
    assert (d.publish_status, d.published_status, d.published) == ("finished, no id", "n/a", None)
    assert rows["results/sft/b2"].submit_status == "none"


def test_without_lookup_no_join_is_planned(listing, configs):
    from plan_checks import plan_text

    df = cw.run_status(listing, configs)
    assert {r.published_status for r in df.collect()} == {"skipped"}
    assert plan_text(df.select("path", "finished")).count("Join") <= 1


def test_filters_and_counts(status, published):
    paths = lambda df: {r.path for r in df.collect()}
    assert paths(catalogue.publishable(status)) == {"results/sft/B"}
    assert paths(catalogue.resubmittable(status)) == set()
    assert paths(catalogue.exclude_finished(status)) == {"results/sft/a", "results/sft/b2"}
    assert paths(catalogue.exclude_published(status, published)) == {
        "results/sft/a", "results/sft/b2", "results/dpo/d",
    }
    assert catalogue.catalogue_counts(status).first().asDict() == {
        "runs": 4, "finished": 2, "publishable": 1, "resubmittable": 0, "skipped_finished": 2,
        "published": 1,
    }
    assert [r.run for r in catalogue.in_listing_order(status).collect()] == ["a", "B", "b2", "d"]


def test_finished_by_semi_join_agrees(status, listing):
    by_join = catalogue.finished_runs(status, listing)
    assert {r.path for r in by_join.collect()} == {"results/sft/B", "results/dpo/d"}


def test_manifests(listing, status):
    entries = run_entries(listing)
    assert {(r.src, r.dst) for r in catalogue.artifact_manifest(entries).collect()} == {
        (f"results/sft/a/checkpoint-10/{f}", f"results/sft/a/artifacts/10/{f}")
        for f in ("model.safetensors", "latest", "xlatest")
    }
    assert {tuple(r) for r in catalogue.upload_manifest(entries, status).collect()} == {
        ("org/b", "results/sft/B/train_results.json", "train_results.json"),
        ("org/b", "results/sft/B/weights.bin", "weights.bin"),
    }


@pytest.mark.parametrize(
    "config,expected",
    [
        ('{"hub_model_id": " a/b "}', "a/b"),
        ('{"hub_model_id": "\\n\\u2003a/b\\t"}', "a/b"),
        ('{"hub_model_id": ""}', None),
        ('{"hub_model_id": "  "}', None),
        ('{"hub_model_id": 12}', None),
        ('{"hub_model_id": ["a"]}', None),
        ('{"hub_model_id": null}', None),
        ('{"other": "a"}', None),
        ('{"hub_model_id": ', None),
        ("[1]", None),
        ('"text"', None),
        (None, None),
    ],
)
def test_hub_id_never_fails(spark, config, expected):
    df = spark.createDataFrame([(config,)], "c string")
    assert df.select(hub_id(F.col("c"))).first()[0] == expected


def test_a_run_with_very_many_files_sends_few_rows(spark, configs):
    """The summary aggregates before it shuffles, so a hot run costs no hot task."""
    many = spark.range(20_000).select(
        F.concat(F.lit("results/sft/hot/checkpoint-"), F.col("id")).alias("path"),
        F.lit(True).alias("is_dir"),
    )
    row = catalogue.summarise_runs(run_entries(many)).first()
    assert row.latest_checkpoint_step == 19_999


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_the_plain_join(spark, how):
    left = spark.range(500).select(
        "id", F.when(F.col("id") % 7 > 0, F.least(F.col("id") % 40, F.lit(9))).alias("k")
    )
    right = spark.createDataFrame([(9, "x"), (3, "y"), (77, "z"), (None, "n")], "k long, v string")
    salted = salted_join(left, right, ["k"], how, spread_by=F.col("id"), salts=5)
    plain = left.join(right, ["k"], how)
    assert salted.columns == plain.columns
    assert sorted(map(repr, salted.collect())) == sorted(map(repr, plain.collect()))


def test_a_hot_run_and_a_hot_id_lose_nothing(spark):
    files = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("results/sft/hot/f"), F.col("id")))
        .when(F.col("id") % 3 == 1, F.concat(F.lit("results/sft/r"), F.col("id"), F.lit("/train_results.json")))
        .otherwise(F.concat(F.lit("results/sft/r"), F.col("id"), F.lit("/x")))
        .alias("path"),
        F.lit(False).alias("is_dir"),
    ).union(spark.createDataFrame([("results/sft/hot/train_results.json", False)], "path string, is_dir boolean"))
    runs = spark.range(3000).where("id % 3 = 1").select(
        F.concat(F.lit("results/sft/r"), F.col("id")).alias("run"),
        F.lit('{"hub_model_id": "org/shared"}').alias("config_json"),
    ).union(spark.createDataFrame([("results/sft/hot", '{"hub_model_id": "org/hot"}')], "run string, config_json string"))
    known = spark.createDataFrame([("org/shared",)], "repo_id string")
    status = cw.run_status(files, runs, known)
    assert status.where("published").count() == 1000
    assert status.where("published IS NULL").count() == 1000
    manifest = catalogue.upload_manifest(run_entries(files), status)
    assert manifest.where("repo_id = 'org/hot'").count() == 1001
    assert manifest.count() == 2001
    assert catalogue.exclude_published(status, known).count() == 1001


def test_a_run_with_two_configs_stays_one_row(spark):
    runs = spark.createDataFrame([("r1",), ("r2",)], "path string")
    configs = spark.createDataFrame([("r1", "b"), ("r1", "a"), ("r1", None)], "run string, hub_model_id string")
    rows = {r.path: r.hub_model_id for r in catalogue.attach_hub_ids(runs, configs).collect()}
    assert rows == {"r1": "a", "r2": None}


def test_json_configs_from_files(spark, tmp_path):
    for run, config in CONFIGS:
        (tmp_path / run).mkdir(parents=True, exist_ok=True)
        (tmp_path / run / "config.json").write_text(config)
    found = {r.run: r.config_json for r in scan_configs(spark, f"file://{tmp_path}", "config.json").collect()}
    assert found == dict(CONFIGS)


def test_yaml_configs(spark, tmp_path):
    pytest.importorskip("yaml")
    texts = {"a b": "hub_model_id: ' x/y '\nlr: 1.0e-5", "b": "- 1", "c": "a: [", "d": "hub_model_id: 5",
             "e": "2020-01-01: x\nhub_model_id: e/e\n1: 2", "f": "lr: .inf\nhub_model_id: f/f", "g": "hub_model_id: g/g\nwhen: 2020-01-01"}
    for run, text in texts.items():
        (tmp_path / run).mkdir()
        (tmp_path / run / "config.yaml").write_text(text)
    configs = scan_configs(spark, str(tmp_path))
    rows = {r.run: r.id for r in configs.select("run", hub_id(F.col("config_json")).alias("id")).collect()}
    assert rows == {"a b": "x/y", "b": None, "c": None, "d": None, "e": "e/e", "f": "f/f", "g": "g/g"}
