import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkwell.config import RunConfig
from inkwell.operators.ledger import (
    failed_lines,
    job_state_counts,
    shard_ledger,
    shards_to_submit,
    status_board,
    write_completed,
)
from inkwell.sources.inputs import AmbiguousSplitError, NoDatasetFilesError, describe_input, load_configured, load_input
from inkwell.sources.ledgers import read_jobs, read_ledger
from inkwell.sources.progress_log import progress_file_report, read_progress, read_progress_records


def test_nested_folders_and_other_files(spark, out):
    spark.range(5).write.parquet(f"{out}/a/b")
    spark.range(5, 8).write.parquet(f"{out}/c")
    with open(f"{out}/c/x.incomplete", "w") as handle:
        handle.write("half")
    assert load_input(spark, "parquet", out, check_splits=False).count() == 8
    with pytest.raises(AmbiguousSplitError, match=r"\['a', 'c'\]"):
        load_input(spark, "parquet", out)
    assert load_input(spark, "parquet", out, split="c").count() == 3
    with pytest.raises(ValueError, match="not found"):
        load_input(spark, "parquet", out, split="dev")


def test_empty_folder(spark, tmp_path):
    for path in (str(tmp_path), str(tmp_path / "absent")):
        with pytest.raises(NoDatasetFilesError):
            load_input(spark, "parquet", path)


def test_partition_folders_are_one_table(spark, out):
    spark.range(6).withColumn("part", F.col("id") % 2).write.partitionBy("part").parquet(out)
    assert sorted(load_input(spark, "parquet", out).columns) == ["id", "part"]


def test_columns_and_filter_reach_the_scan(spark, out):
    spark.range(10).select("id", F.lit("t").alias("text"), F.lit(1).alias("n")).write.parquet(out)
    plan = load_input(spark, "parquet", out, columns=["id"], where="n = 1")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,n:int>" in plan and "EqualTo(n,1)" in plan


def test_text_and_schema_options(spark, out):
    spark.createDataFrame([("a,1",), ("b,2",)], "value string").write.text(out)
    assert load_input(spark, "text", out).count() == 2
    rows = load_input(spark, "csv", out, schema="k string, n int")
    assert sorted((r.k, r.n) for r in rows.collect()) == [("a", 1), ("b", 2)]


def test_description(spark, out):
    spark.range(10).repartition(3).write.parquet(out)
    row = describe_input(spark.read.parquet(out)).first()
    assert (row.num_rows, row.num_files, row.num_columns, row.schema) == (10, 3, 1, "struct<id:bigint>")


@pytest.mark.parametrize("stream", [True, False])
def test_arrow_folders(spark, tmp_path, stream):
    table = pa.table({"id": ["a", "b"], "messages": [[{"role": "user", "content": "x"}], []]})
    for i in range(2):
        with pa.OSFile(str(tmp_path / f"data-{i}.arrow"), "wb") as sink:
            writer = (pa.ipc.new_stream if stream else pa.ipc.new_file)(sink, table.schema)
            writer.write_table(table)
            writer.close()
    (tmp_path / "state.json").write_text("{}")
    config = RunConfig(api_type="chat-completion", model="m", dataset_path=str(tmp_path), output_path="o", max_connections=1, dataset_type="hf-disk")
    rows = load_configured(spark, config)
    assert rows.count() == 4
    assert rows.where("id = 'a'").first().messages[0].content == "x"


def test_configured_options(spark, out):
    spark.range(10).write.parquet(f"{out}/deu/train")
    spark.range(3).write.parquet(f"{out}/deu/test")
    base = dict(api_type="completion", model="m", dataset_path=out, output_path="o", max_connections=1)
    config = RunConfig(dataset_type="hf", dataset_kwargs={"name": "deu", "split": "train", "cache_dir": "/x", "columns": ["id"]}, **base)
    assert load_configured(spark, config).count() == 10
    assert load_configured(spark, RunConfig(dataset_type="parquet", dataset_kwargs={"filter": "id < 2"}, **base)).count() == 4
    with pytest.raises(AmbiguousSplitError):
        load_configured(spark, RunConfig(dataset_type="hf", dataset_kwargs={"name": "deu"}, **base))
    with pytest.raises(ValueError, match="stream"):
        load_configured(spark, RunConfig(dataset_type="hf", dataset_kwargs={"streaming": True}, **base))


def record(shard, timestamp, completed, eta=0):
    rates = {n: 1.5 for n in ("requests_per_second", "total_tokens_per_second", "prompt_tokens_per_second", "completion_tokens_per_second")}
    return {
        "timestamp": timestamp,
        "shard": shard,
        "num_shards": 2,
        "progress": {"completed": completed, "total": 100, "new": completed, "existing": 0, "eta_seconds": eta, "eta_formatted": "1s"},
        "throughput": {"overall": rates, "last_interval": {"duration_seconds": 60, "new": 1, "existing": 0, **rates}},
    }


def test_progress_files(spark, tmp_path):
    for shard in range(2):
        lines = [json.dumps(record(shard, 1751465045.2584667 + i, 10 * i, eta=0 if i else 2.5)) for i in range(3)]
        (tmp_path / f"{shard}-progress.jsonl").write_text("\n".join(lines) + "\n")
    good = [str(tmp_path / f"{i}-progress.jsonl") for i in range(2)]
    rows = read_progress(spark, good)
    assert rows.columns == [
        "shard", "num_shards", "timestamp", "datetime", "completed", "total", "new", "existing", "eta_seconds", "eta_formatted",
        "overall_requests_ps", "overall_total_tps", "overall_prompt_tps", "overall_completion_tps",
    ]
    assert rows.count() == 6
    first = rows.orderBy("shard", "timestamp").first()
    assert (first.eta_seconds, first.overall_total_tps, str(first.datetime)[:19]) == (2.5, 1.5, "2025-07-02 14:04:05")
    bad = tmp_path / "2-progress.jsonl"
    bad.write_text(json.dumps(record(2, 1.0, 1)) + "\n{broken\n")
    assert read_progress(spark, [*good, str(bad)]).count() == 6
    assert read_progress(spark, [*good, str(bad)], skip="line").count() == 7
    report = {r.file.rsplit("/", 1)[-1]: (r.good_lines, r.bad_lines) for r in
              progress_file_report(read_progress_records(spark, [*good, str(bad)]).cache()).collect()}
    assert report["2-progress.jsonl"] == (1, 1) and report["0-progress.jsonl"] == (3, 0)
    with pytest.raises(ValueError, match="no valid"):
        read_progress(spark, str(bad))


def test_ledgers(spark, tmp_path):
    assert read_ledger(spark, str(tmp_path / "absent")).count() == 0
    done = tmp_path / "done.log"
    done.write_text("3\n 12 \n3\n\nx\n")
    assert sorted(r.shard for r in read_ledger(spark, str(done)).collect()) == [3, 12]
    failed = tmp_path / "failed.log"
    failed.write_text(
        "0 2025-07-02 16:13:38 manual_cancellation 17254306-1 Job was manually cancelled\n"
        "7 2025-07-02 16:14:00 gpu_idle_timeout 17254306-2\nnoise\n"
    )
    rows = read_ledger(spark, str(failed), "failed").orderBy("shard").collect()
    assert [(r.shard, str(r.failed_at), r.reason, r.job, r.info) for r in rows] == [
        (0, "2025-07-02 16:13:38", "manual_cancellation", "17254306-1", "Job was manually cancelled"),
        (7, "2025-07-02 16:14:00", "gpu_idle_timeout", "17254306-2", ""),
    ]
    with pytest.raises(ValueError):
        read_ledger(spark, str(done), "other")


def test_ledger_states_and_lines(spark, tmp_path):
    completion = spark.createDataFrame(
        [(0, 5, 5, 0, 0, True), (1, 5, 3, 0, 2, False), (2, 5, 3, 0, 0, False), (3, 5, 5, 0, 0, True)],
        "shard int, total long, succeeded long, failed long, aborted long, complete boolean",
    )
    invalid = spark.createDataFrame([(3,)], "shard int")
    ledger = shard_ledger(completion, invalid)
    assert {r.shard: r.state for r in ledger.collect()} == {0: "complete", 1: "breaker_tripped", 2: "incomplete", 3: "validation_failed"}
    assert shard_ledger(completion).where("shard = 3").first().state == "complete"
    path = str(tmp_path / "completed")
    write_completed(ledger, path)
    write_completed(shard_ledger(completion), path)
    assert sorted(r.shard for r in read_ledger(spark, path).collect()) == [0, 3]
    lines = failed_lines(ledger, "2025-07-02 16:13:38", "1-2")
    lines.write.text(str(tmp_path / "failed"))
    back = {r.shard: (r.reason, r.info) for r in read_ledger(spark, str(tmp_path / "failed"), "failed").collect()}
    assert back[3][0] == "data_validation_failed" and back[1] == ("inference_script_failed", "breaker_tripped: 3 of 5 ok")


def test_jobs(spark, tmp_path):
    snapshot = tmp_path / "jobs.json"
    jobs = [
        {"name": "run-000000", "job_id": 5, "job_state": ["RUNNING"], "extra": {"x": 1}},
        {"name": "run-000001", "job_id": 6, "job_state": "PENDING"},
        {"name": "run-000002", "job_id": 7, "job_state": ["FAILED"]},
        {"name": "other-000003", "job_id": 8, "job_state": ["COMPLETING", "X"]},
    ]
    snapshot.write_text(json.dumps({"jobs": jobs, "meta": {}}, indent=1))
    mine = read_jobs(spark, str(snapshot), "run")
    assert sorted((r.shard, r.job_id, tuple(r.states)) for r in mine.collect()) == [(0, 5, ("RUNNING",)), (1, 6, ("PENDING",))]
    assert read_jobs(spark, str(snapshot), active_only=False).count() == 4
    assert {r.state: r.num_jobs for r in job_state_counts(mine).collect()} == {"RUNNING": 1, "PENDING": 1}
    completed = spark.createDataFrame([(3,)], "shard int")
    assert sorted(r.shard for r in shards_to_submit(6, completed, mine).collect()) == [2, 4, 5]
    assert [r.shard for r in shards_to_submit(6, completed, mine, limit=2).collect()] == [2, 4]
    board = {r.shard: (r.completed, r.state, r.job_id) for r in status_board(4, completed, mine).collect()}
    assert board == {0: (False, "RUNNING", "5"), 1: (False, "PENDING", "6"), 2: (False, "-", "-"), 3: (True, "-", "-")}
    for text in ('{"jobs": {}}', "{}"):
        snapshot.write_text(text)
        with pytest.raises(ValueError, match="not a list"):
            read_jobs(spark, str(snapshot))


def test_absent_progress_files_are_passed_over(spark, tmp_path):
    from inkwell.sources.progress_log import read_progress_records

    assert read_progress_records(spark, [str(tmp_path / "absent.jsonl")]).count() == 0
