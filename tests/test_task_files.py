"""Arrow files as a data source, and the sink that keeps what finished tasks wrote."""

import json
import os
import sys
import threading
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from inkwell.config import RunConfig
from inkwell.operators.client import StubClient
from inkwell.plans.run import run
from inkwell.sinks.task_files import append_task_files
from inkwell.sources import arrow_files, files
from inkwell.sources.arrow_files import batches_between, read_arrow_files
from inkwell.sources.inputs import load_input
from inkwell.sources.responses import read_results

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def write(path, table, stream=True, rows=10):
    with pa.OSFile(str(path), "wb") as sink:
        with (pa.ipc.new_stream if stream else pa.ipc.new_file)(sink, table.schema) as writer:
            writer.write_table(table, max_chunksize=rows)


def table(n=1000):
    return pa.table({
        "id": list(range(n)), "name": [None if i % 7 == 0 else f"n{i % 13}" for i in range(n)],
        "day": pa.array([i % 40 for i in range(n)], pa.date32()), "x": [float("nan") if i % 9 == 0 else i / 3 for i in range(n)],
        "text": ["é" * (i % 50) for i in range(n)],
    })


@pytest.mark.parametrize("stream", [True, False])
@pytest.mark.parametrize("step", [1, 700, 1 << 30])
def test_ranges_of_a_file_hold_every_batch_once(tmp_path, stream, step):
    path, whole = tmp_path / "a.arrow", table(300)
    write(path, whole, stream)
    size = os.path.getsize(path)
    with pa.memory_map(str(path)) as source:
        found = [b for start in range(0, size, max(step, 64)) for b in batches_between(source, start, start + max(step, 64))]
    read = pa.Table.from_batches(found)
    assert len(found) == 30 and read.schema == whole.schema
    assert all(read[c].to_pylist() == whole[c].to_pylist() for c in ("id", "name", "day", "text"))


@pytest.mark.parametrize("stream", [True, False])
def test_one_large_file_is_read_by_many_tasks(spark, tmp_path, stream):
    write(tmp_path / "a.arrow", table(), stream)
    spark.conf.set(arrow_files.PARTITION_BYTES, "4096")
    try:
        df = load_input(spark, "arrow", str(tmp_path))
        assert df.rdd.getNumPartitions() > 8
        assert df.agg(F.count("*"), F.sum("id"), F.count_distinct("id")).first()[:] == (1000, 499500, 1000)
        used = df.select(F.spark_partition_id().alias("p")).distinct().count()
        assert used > 8
    finally:
        spark.conf.unset(arrow_files.PARTITION_BYTES)


CONDITIONS = [
    "id = 5", "id > 990", "id >= 990 AND name IS NOT NULL", "name IS NULL", "name = 'n3' OR name IS NULL", "NOT (name = 'n3')",
    "name IN ('n1', 'n2', NULL)", "name NOT IN ('n1', 'n2')", "name LIKE 'n1%'", "name LIKE '%2'", "name LIKE '%1%'", "name LIKE 'n_'",
    "day < DATE'1970-01-05'", "x > 300", "x = double('NaN')", "name <=> NULL", "length(text) = 3", "id < 10 AND name LIKE 'N%'", "text = ''",
]


@pytest.mark.parametrize("condition", CONDITIONS)
def test_filters_mean_what_they_mean_to_spark(spark, tmp_path, condition):
    write(tmp_path / "a.arrow", table())
    plain = spark.createDataFrame(table().to_pandas(), "id bigint, name string, day date, x double, text string")
    got = load_input(spark, "arrow", str(tmp_path), columns=["id"], where=condition)
    assert got.columns == ["id"]
    want = plain.where(condition).select("id")
    if condition.startswith("name"):  # pandas has no null in text columns of its own
        names = {i: None if i % 7 == 0 else f"n{i % 13}" for i in range(1000)}
        want = spark.createDataFrame(list(names.items()), "id bigint, name string").where(condition).select("id")
    assert sorted(got.collect()) == sorted(want.collect())


def test_columns_and_filters_reach_the_source(spark, tmp_path):
    write(tmp_path / "a.arrow", table())
    df = load_input(spark, "arrow", str(tmp_path), columns=["id"], where="name = 'n3' AND length(text) > 2")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    relation = next(line for line in plan.split("\n") if "RelationV2" in line or "inkwell_arrow" in line)
    assert "day" not in relation and "x#" not in relation and "name#" in relation
    physical = df._jdf.queryExecution().executedPlan().toString()
    assert "n3" not in "".join(line for line in physical.split("\n") if "Filter" in line and "BatchScan" not in line)


def test_dictionaries_missing_columns_and_other_types(spark, tmp_path):
    write(tmp_path / "a.arrow", pa.table({"k": pa.array(["a", "b", "a"]).dictionary_encode(), "n": pa.array([1, 2, 3], pa.int64())}))
    write(tmp_path / "b.arrow", pa.table({"n": pa.array([4], pa.int32())}))
    listed = files.list_files(spark, str(tmp_path), "*.arrow")
    rows = read_arrow_files(spark, listed).collect()
    assert sorted((r.n, r.k) for r in rows) == [(1, "a"), (2, "b"), (3, "a"), (4, None)]


def test_mounted_paths_and_stores_that_only_spark_opens(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.arrow", table(50))
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.arrowtest.link./data", f"file://{tmp_path}")
    path = "viewfs://arrowtest/data/in"
    assert load_input(spark, "arrow", path).agg(F.sum("id")).first()[0] == 1225
    monkeypatch.setattr(arrow_files, "direct", lambda *_: None)
    assert load_input(spark, "arrow", path, columns=["id"], where="id > 47").count() == 2


def test_saved_arrow_files_are_read_back(spark, out):
    df = spark.range(100).select("id", F.array("id").alias("list"), (F.col("id") % 3).cast("int").alias("part"))
    assert append_task_files(df.repartition(4), out, "arrow", max_rows=10)
    back = load_input(spark, "arrow", out)
    assert sorted(back.collect()) == sorted(df.collect())
    assert len(files.list_files(spark, out, "*.arrow")) >= 10 and not [n for n in os.listdir(out) if n.startswith("_")]


def test_folders_by_a_column(spark, out):
    df = spark.range(30).select("id", F.when(F.col("id") % 4 > 0, F.col("id") % 4).cast("int").alias("part"))
    assert append_task_files(df, out, by="part") and append_task_files(df.where("id < 0"), out, by="part")
    assert sorted(spark.read.parquet(out).select("id", "part").collect()) == sorted(df.collect())
    assert sorted(n for n in os.listdir(out)) == ["part=1", "part=2", "part=3", "part=__HIVE_DEFAULT_PARTITION__"]


class Dies:
    """Ends its worker process at one prompt, once the other tasks have had time to finish."""

    def __init__(self, n):
        self.n = n

    def __call__(self, endpoint):
        return self

    def call(self, request, deadline_s):
        if len(json.loads(request)["prompt"]) == self.n:
            time.sleep(4)
            os._exit(1)
        return StubClient().call(request, deadline_s)


class Counts:
    """Writes the prompts it is asked for into a folder."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self, endpoint):
        return self

    def call(self, request, deadline_s):
        n = len(json.loads(request)["prompt"])
        open(f"{self.folder}/{n}-{time.time_ns()}", "w").close()
        return StubClient().call(request, deadline_s)


def test_a_wave_that_dies_keeps_its_finished_tasks(spark, out, tmp_path):
    config = RunConfig(
        api_type="completion", model="m", dataset_path="x", output_path=out, max_connections=8, num_workers=2, num_inference_servers=4
    )
    prompts = spark.range(80).select(F.col("id").cast("string").alias("id"), F.repeat(F.lit("x"), F.col("id").cast("int") + 1).alias("prompt"))
    with pytest.raises(Exception, match="(?i)worker|exit|crash|abort"):
        run(spark, config, Dies(80), prompts, num_waves=1)
    kept = {r.id for r in read_results(spark, out, "completion").select("id").collect()}
    assert 0 < len(kept) < 80 and "79" not in kept
    seen = tmp_path / "seen"
    seen.mkdir()
    run(spark, config, Counts(str(seen)), prompts, num_waves=1)
    asked = sorted(int(name.split("-")[0]) - 1 for name in os.listdir(seen))
    assert asked == sorted(set(range(80)) - {int(i) for i in kept})
    counts = read_results(spark, out, "completion").groupBy("id").count().collect()
    assert len(counts) == 80 and {r["count"] for r in counts} == {1}
    assert not [n for n in os.listdir(out) if n.startswith("_writing")]


def test_small_batches_share_row_groups(spark, out):
    rows = spark.range(0, 5000, 1, 1).withColumn("shard", F.lit(0))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    try:
        assert append_task_files(rows, out, by="shard")
        assert append_task_files(rows, f"{out}-cut", by="shard", max_rows=300)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    (file,) = [name for name, _ in files.list_files(spark, out)]
    meta = pq.ParquetFile(file.removeprefix("file:")).metadata
    assert (meta.num_rows, meta.num_row_groups) == (5000, 1)
    assert spark.read.parquet(out).agg(F.sum("id"), F.count_distinct("id")).first()[:] == (12497500, 5000)
    cut = [pq.ParquetFile(n.removeprefix("file:")).metadata.num_rows for n, _ in files.list_files(spark, f"{out}-cut")]
    assert sorted(cut) == [200] + [300] * 16


def test_a_dying_client_waits_for_the_files_of_the_others(tmp_path):
    from inkwell.plans.catalog.answers import _FailsAt

    folder = tmp_path / "_writing-1" / "shard=1"
    folder.mkdir(parents=True)
    (folder / "part.parquet").write_bytes(b"PAR1 some rows so far")

    def finish():
        with open(folder / "part.parquet", "ab") as file:
            file.write(b"PAR1")

    later = threading.Timer(5, finish)
    later.start()
    began = time.time()
    _FailsAt("x", str(tmp_path), 1).wait()
    assert time.time() - began >= 8
