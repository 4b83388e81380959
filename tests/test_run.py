import json
import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import inkwell.plans.run as run_module
from inkwell.config import RunConfig
from inkwell.operators.client import RequestFailed, StubClient
from inkwell.operators.outcomes import IncompleteShardsError, check_complete, request_log
from inkwell.operators.shard import with_shard
from inkwell.operators.validate import InvalidInputError
from inkwell.plans.run import BreakerTripped, run
from inkwell.schemas import results_schema
from inkwell.sources.progress_log import read_progress
from inkwell.sources.responses import done_ids, read_results


# Test modules are not installed on workers: send this module's classes by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def config(out, **changes):
    values = dict(api_type="completion", model="m", dataset_path="x", output_path=out, max_connections=8, num_workers=2,
                  num_inference_servers=3)
    return RunConfig(**{**values, **changes})


def prompts(spark, n=60):
    length = F.col("id").cast("int") + 1
    return spark.range(n).select(F.col("id").cast("string").alias("id"), F.repeat(F.lit("x"), length).alias("prompt"))


def ids(spark, out, status="ok"):
    return sorted(int(r.id) for r in read_results(spark, out, "completion").where(F.col("status") == status).collect())


class FailAbove:
    """Fails prompts longer than a limit with one error text."""

    def __init__(self, limit, error):
        self.limit, self.error = limit, error

    def __call__(self, endpoint):
        return self

    def call(self, request, deadline_s):
        if len(json.loads(request)["prompt"]) > self.limit:
            raise RequestFailed(self.error)
        return StubClient().call(request, deadline_s)


@pytest.mark.parametrize("waves", [1, 3])
def test_every_row_is_answered_once(spark, out, waves):
    summary = run(spark, config(out), StubClient(), prompts(spark), num_waves=waves)
    assert (summary.new, summary.errors, summary.waves) == (60, 0, waves)
    assert summary.completion_tokens == 8 * 60
    assert ids(spark, out) == list(range(60))
    results = read_results(spark, out, "completion")
    assert results.select("wave").distinct().count() == waves
    assert {f.name for f in results.schema} == {f.name for f in results_schema("completion")}
    folders = [n for n in os.listdir(out) if n.startswith("shard=")]
    assert sorted(folders) == ["shard=0", "shard=1", "shard=2"]


def test_second_run_sends_nothing(spark, out):
    run(spark, config(out), StubClient(), prompts(spark))
    again = run(spark, config(out), FailAbove(0, "must not be called"), prompts(spark))
    assert (again.new, again.errors) == (0, 0)
    more = run(spark, config(out), StubClient(), prompts(spark, 70))
    assert more.new == 10


def test_stopped_run_resumes_where_it_was(spark, out):
    def stop(wave):
        if wave == 1:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        run(spark, config(out), StubClient(), prompts(spark), num_waves=4, after_wave=stop)
    first = ids(spark, out)
    assert 0 < len(first) < 60
    summary = run(spark, config(out), StubClient(), prompts(spark), num_waves=2)
    assert summary.new == 60 - len(first)
    assert ids(spark, out) == list(range(60))


@pytest.mark.parametrize("small", [0, 10**9])
def test_large_done_sets_are_joined_before_the_waves(spark, out, monkeypatch, small):
    monkeypatch.setattr(run_module, "SMALL_DONE_BYTES", small)
    run(spark, config(out), StubClient(), prompts(spark, 25))
    summary = run(spark, config(out), StubClient(), prompts(spark), num_waves=3)
    assert summary.new == 35
    assert ids(spark, out) == list(range(60))


def test_waves_by_file_read_their_own_files_only(spark, out, tmp_path):
    folder = str(tmp_path / "in")
    prompts(spark, 200).repartition(24, "id").write.parquet(folder)
    source = spark.read.parquet(folder)
    parts = list(run_module._waves(source, 3, str(tmp_path / "stage")))
    assert not os.path.exists(tmp_path / "stage")
    got = [[r.id for r in part.collect()] for part in parts]
    assert sorted(int(i) for part in got for i in part) == list(range(200))
    assert all(0 < len(part) < 200 for part in got)
    for part in parts:
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "xxhash64(file_path" in plan.split("DataFilters:")[1].split("]")[0]
    run(spark, config(out), StubClient(), source, num_waves=3)
    assert ids(spark, out) == list(range(200))


def test_run_from_a_configured_folder(spark, out, tmp_path):
    folder = str(tmp_path / "in")
    prompts(spark, 40).withColumnRenamed("prompt", "text").write.parquet(folder)
    made = config(
        out, dataset_path=folder, api_type="chat-completion", input_column_name="messages",
        apply_udf="template_messages", apply_udf_kwargs={"template": "Rate: {document}"},
    )
    assert run(spark, made, StubClient()).new == 40


def test_errors_are_kept_as_rows_and_counted(spark, out):
    error = "This model has a maximum context length of 10"
    summary = run(spark, config(out), FailAbove(40, error), prompts(spark))
    assert (summary.new, summary.errors) == (40, 20)
    results = read_results(spark, out, "completion")
    failed = results.where("status = 'error'")
    assert failed.count() == 20 and failed.where("response IS NOT NULL").count() == 0
    assert {r.error_class for r in failed.collect()} == {"context_length"}
    # Too long stays too long: not sent again unless asked to.
    assert run(spark, config(out), StubClient(), prompts(spark)).new == 0
    assert run(spark, config(out), StubClient(), prompts(spark), retry_failed=True).new == 20
    assert done_ids(read_results(spark, out, "completion"), retry_failed=True).count() == 60


def test_other_errors_are_retried_by_the_next_run(spark, out):
    run(spark, config(out), FailAbove(40, "bad request"), prompts(spark))
    assert run(spark, config(out), StubClient(), prompts(spark)).new == 20


def test_succeeded_completion_and_success_ratio(spark, out):
    failing = FailAbove(40, "bad request")
    with pytest.raises(IncompleteShardsError, match="failed of"):
        run(spark, config(out), failing, prompts(spark), completion="succeeded")
    with pytest.raises(IncompleteShardsError):
        run(spark, config(out, min_success_ratio=0.99), failing, prompts(spark))
    run(spark, config(out), StubClient(), prompts(spark), completion="succeeded")


def test_breaker_raises_after_the_wave_is_written(spark, out):
    made = config(out, max_consecutive_failures=3, max_connections=1, num_workers=1, num_inference_servers=1)
    with pytest.raises(BreakerTripped, match="not sent in wave 0"):
        run(spark, made, FailAbove(0, "Connection refused"), prompts(spark), num_waves=2)
    results = read_results(spark, out, "completion")
    assert results.where("status = 'error'").count() == 3
    assert results.where("status = 'aborted'").count() > 0
    summary = run(spark, made, StubClient(), prompts(spark))
    assert summary.new == 60


def test_bad_input_is_refused_before_anything_is_sent(spark, out):
    bad = prompts(spark, 5).union(spark.createDataFrame([("x", None)], "id string, prompt string"))
    with pytest.raises(InvalidInputError):
        run(spark, config(out), StubClient(), bad)
    assert not os.path.exists(out)


def test_progress_is_appended_with_the_run(spark, out, tmp_path):
    log = str(tmp_path / "progress")
    run(spark, config(out), StubClient(), prompts(spark, 30), progress_path=log, progress_interval_s=1)
    run(spark, config(out), StubClient(), prompts(spark), progress_path=log, progress_interval_s=1)
    rows = read_progress(spark, log)
    last = rows.groupBy("shard").agg(F.max_by("completed", "timestamp").alias("n"), F.max("total").alias("t")).collect()
    # The second run counts what the first one answered as existing.
    assert len(last) == 3 and sum(r.t for r in last) == 60 and sum(r.n for r in last) == 60
    assert spark.read.json(log).select("run_id").distinct().count() == 2


def test_row_keys_come_from_the_table(spark, out, tmp_path):
    folder = str(tmp_path / "in")
    spark.range(300).select(F.lit("same").alias("id"), F.lit("p").alias("prompt")).coalesce(1).write.parquet(folder)
    made = config(out, num_inference_servers=1, num_workers=4)
    run(spark, made, StubClient(), spark.read.parquet(folder))
    assert read_results(spark, out, "completion").count() == 300
    assert len([n for n in os.listdir(f"{out}/shard=0") if n.endswith(".parquet")]) == 4


def test_incomplete_shards_are_named(spark, out):
    run(spark, config(out), StubClient(), prompts(spark))
    totals = spark.createDataFrame([(0, 10_000), (1, 1)], "shard int, total long")
    with pytest.raises(IncompleteShardsError, match="shard 0"):
        check_complete(totals, request_log(read_results(spark, out, "completion")))


@pytest.mark.parametrize("shard_by", ["contiguous", "file"])
def test_shards_as_rows_are_stored(spark, out, tmp_path, shard_by):
    stored = str(tmp_path / "stored")
    prompts(spark).repartitionById(6, (F.col("id").cast("int") / 10).cast("int")).write.parquet(stored)
    rows = spark.read.parquet(stored)
    summary = run(spark, config(out), StubClient(), rows, num_waves=2, shard_by=shard_by)
    assert summary.new == 60 and ids(spark, out) == list(range(60))
    placed = with_shard(rows, 3, shard_by)
    want = {r.id: r.shard for r in placed.select("id", "shard").collect()}
    assert {r.id: r.shard for r in read_results(spark, out, "completion").select("id", "shard").collect()} == want
    assert run(spark, config(out), StubClient(), rows, shard_by=shard_by, shards=[0, 2]).new == 0


def test_repeated_ids_stop_a_run_that_asks_for_it(spark, out):
    twice = prompts(spark, 5).union(prompts(spark, 2))
    with pytest.raises(InvalidInputError, match="id_repeated: 2 rows"):
        run(spark, config(out), StubClient(), twice, check_unique=True)
    assert read_results(spark, out, "completion").count() == 0


def test_waves_take_several_parts_once_they_are_timed(spark, out, monkeypatch):
    monkeypatch.setattr(run_module, "default_waves", lambda rows, config: 8)
    summary = run(spark, config(out), StubClient(), prompts(spark))
    assert summary.waves == 3  # of 1, 4 and 3 parts
    assert ids(spark, out) == list(range(60))


def test_pace_follows_the_clock_and_a_tasks_share(monkeypatch):
    clock = [0.0]
    monkeypatch.setattr(run_module.time, "time", lambda: clock[0])
    pace = run_module._Pace(1_000_000, 50, config("x"))  # 20,000 rows a part, 6 tasks of 50,000 rows at most
    assert pace.next_parts() == 1
    got = []
    for seconds in (10, 10, 10, 5400, 100_000):
        clock[0] += seconds
        got.append(pace.next_parts())
    assert got == [4, 15, 15, 5, 1]


def test_done_ids_are_joined_once_where_all_waves_would_send_too_many(spark, out, monkeypatch):
    run(spark, config(out), StubClient(), prompts(spark, 25))
    calls = []
    joined = run_module.pending
    monkeypatch.setattr(run_module, "SMALL_DONE_BYTES", 1000)  # more than the stored ids, less than three times them
    monkeypatch.setattr(run_module, "pending", lambda *a: calls.append(1) or joined(*a))
    assert run(spark, config(out), StubClient(), prompts(spark), num_waves=3).new == 35
    assert len(calls) == 1
