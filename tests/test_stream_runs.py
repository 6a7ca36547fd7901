"""The catalogue of a stream is the catalogue of the table, whatever the batches."""

import random
from datetime import datetime, timedelta

import pyarrow as pa
import pytest

from convoweave.operators.catalogue import summarise_runs
from convoweave.sources.listing import run_entries
from convoweave.streaming.rows import run_available, stream_table
from convoweave.streaming.runs import _parts, current_runs, stream_runs

SCHEMA = "path string, is_dir boolean, ts timestamp"
START = datetime(2024, 1, 1)


def at(hours):
    return START + timedelta(hours=hours)


def write(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def drain(spark, folder, out, **options):
    schema = spark.createDataFrame([], SCHEMA).schema
    stream = stream_table(spark, f"{folder}", schema, max_files_per_trigger=1)
    run_available(stream_runs(stream, **options), f"{out}/data", f"{out}/state")
    return {(r.kind, r.run): r for r in current_runs(spark, f"{out}/data").collect()}


def same_as_table(spark, found, rows):
    batch = summarise_runs(run_entries(spark.createDataFrame(rows, SCHEMA)))
    expected = {(r.kind, r.run): r for r in batch.collect()}
    assert found.keys() == expected.keys()
    for key, r in expected.items():
        assert tuple(found[key][c] for c in batch.columns) == tuple(r)


def entries(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        run = f"results/{rng.choice(['sft', 'dpo'])}/r{min(rng.randint(0, 9), rng.randint(0, 9))}"
        path, is_dir = rng.choice([
            (f"{run}/checkpoint-{rng.randint(1, 900)}", True), (f"{run}/checkpoint-{rng.randint(1, 99)}/a.bin", False),
            (f"{run}/slurm/job-{rng.randint(1, 3)}.sh", False), (run, True), (f"{run}/checkpoint-last", True),
            (f"{run}/slurm/deep/job.sh", False), ("logs/x", False), ("recipes/dpo/r3.sh", False), ("recipes/dpo/none.sh", False),
            *([(f"{run}/train_results.json", False)] if i % 9 == 0 else []),
        ])
        out.append((path, is_dir, at(i / 10)))
    return out


@pytest.mark.parametrize("files", [1, 4])
def test_stream_equals_table(spark, tmp_path, files):
    rows = entries(files, 240)
    for k in range(files):
        write(spark, str(tmp_path / "in"), rows[k::files])
    found = drain(spark, str(tmp_path / "in"), str(tmp_path / "out"), repeats_within="2 days", parts=3)
    same_as_table(spark, found, rows)
    paths = {(p, d) for p, d, _ in rows if p.startswith("results/") and not d}
    assert sum(r.n_files for r in found.values()) == len(paths)


def test_it_goes_on_where_it_stopped(spark, tmp_path):
    rows = entries(7, 150)
    for k in range(3):
        write(spark, str(tmp_path / "in"), rows[50 * k : 50 * k + 50])
        found = drain(spark, str(tmp_path / "in"), str(tmp_path / "out"), repeats_within="9 days")
        same_as_table(spark, found, rows[: 50 * k + 50])
    versions = spark.read.parquet(str(tmp_path / "out/data")).groupBy("kind", "run", "part", "version").count()
    assert versions.where("count > 1").isEmpty()  # a restart writes nothing twice
    before = spark.read.parquet(str(tmp_path / "out/data")).count()
    same_as_table(spark, drain(spark, str(tmp_path / "in"), str(tmp_path / "out"), repeats_within="9 days"), rows)
    assert spark.read.parquet(str(tmp_path / "out/data")).count() == before


def test_late_and_repeated_rows(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    run = "results/sft/a"
    batches = [
        [(f"{run}/checkpoint-5", True, at(0)), (f"{run}/w.bin", False, at(0)), (f"{run}/w.bin", False, at(0.5))],
        [(f"{run}/checkpoint-6", True, at(10)), (f"{run}/w.bin", False, at(0.9))],
        # The latest time was hour 10, so hour 2 is late; hour 9.5 is out of order but in time.
        [(f"{run}/checkpoint-99", True, at(2)), (f"{run}/train_results.json", False, at(9.5)), (f"{run}/w.bin", False, at(10.5))],
        [(None, False, at(11)), (f"{run}/x.bin", None, at(11)), (f"{run}/y.bin", False, None)],
    ]
    for rows in batches:
        write(spark, folder, rows)
        found = drain(spark, folder, out, repeats_within="1 hour")
    (r,) = found.values()
    assert (r.finished, r.latest_checkpoint_step, r.last_new) == (True, 6, at(11))
    # w.bin once in the first span and once when it comes back, the marker, x.bin (no directory unless said so).
    assert r.n_files == 4


def test_one_run_is_spread_over_parts(spark, tmp_path):
    rows = [(f"results/sft/big/f{i}", False, at(0)) for i in range(200)]
    write(spark, str(tmp_path / "in"), rows)
    found = drain(spark, str(tmp_path / "in"), str(tmp_path / "out"), parts=8)
    assert found["sft", "big"].n_files == 200
    assert spark.read.parquet(str(tmp_path / "out/data")).select("part").distinct().count() == 8


def test_nothing_to_read(spark, tmp_path):
    write(spark, str(tmp_path / "in"), [("logs/a", False, at(0))])
    assert drain(spark, str(tmp_path / "in"), str(tmp_path / "out")) == {}


def test_tables_are_refused(spark):
    with pytest.raises(ValueError, match="summarise_runs"):
        stream_runs(spark.createDataFrame([], SCHEMA))


def test_only_paths_of_runs_are_state(spark, tmp_path):
    """A state per run and part in Python took 8 ms each, and paths outside the runs were remembered too."""
    rows = [(f"results/sft/r{i}/a.bin", False, at(0)) for i in range(30)]
    write(spark, str(tmp_path / "in"), rows + [(f"logs/{i}", False, at(1)) for i in range(50)])
    stream = stream_table(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema)
    query = (
        stream_runs(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    assert [[s.numRowsTotal for s in p.stateOperators] for p in query.recentProgress if p.numInputRows] == [[30]]


@pytest.mark.parametrize("at_once", [1, 4, 10, 1000])
def test_parts_are_folded_in_bounded_batches(at_once):
    names = ["kind", "run", "part", "version", "listed", "finished", "step", "first_script", "last_script", "override", "files", "last_new"]
    rows = [("sft", f"r{i % 7}", 0, 0, True, i == 9, i, f"s{i}", f"s{i}", None, 1, at(i)) for i in range(60)]
    table = pa.table([pa.array(c) for c in zip(*rows)], names).cast(pa.schema([
        *((n, pa.string()) for n in names[:2]), ("part", pa.int32()), ("version", pa.int64()), ("listed", pa.bool_()),
        ("finished", pa.bool_()), ("step", pa.int64()), *((n, pa.string()) for n in names[7:10]), ("files", pa.int64()),
        ("last_new", pa.timestamp("us")),
    ]))
    out = pa.Table.from_batches(_parts(iter(table.to_batches(max_chunksize=3)), 5 << 32, at_once)).to_pylist()
    assert len({(r["run"], r["version"]) for r in out}) == len(out) and min(r["version"] for r in out) == 5 << 32
    for k in range(7):
        own = [r for r in out if r["run"] == f"r{k}"]
        assert sum(r["files"] for r in own) == len(range(k, 60, 7))
        assert max(r["step"] for r in own) == max(range(k, 60, 7))
        assert min(r["first_script"] for r in own) == min(f"s{i}" for i in range(k, 60, 7))
        assert any(r["finished"] for r in own) == (k == 2)
