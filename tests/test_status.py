import pytest
from pyspark.sql import functions as F

from inkwell.operators.outcomes import outcome_counts, shard_completion, shard_totals, usage_totals
from inkwell.operators.progress import interval_counts, per_hour, progress, progress_records, status_rows
from inkwell.operators.status import (
    current_throughput,
    latest_per_shard,
    only_shards,
    recent,
    run_duration,
    run_summary,
    shard_board,
    shard_stats,
    summary_board,
    throughput_bars,
    throughput_board,
    throughput_stats,
)
from inkwell.schemas import progress_schema

LOG = (
    "id string, shard int, run_id string, wave int, status string, error_class string, error_text string, "
    "started_at timestamp, finished_at timestamp, prompt_tokens int, completion_tokens int, total_tokens int"
)


def log(spark, rows):
    """Rows of (shard, second, status, prompt tokens, completion tokens)."""
    full = []
    for i, (shard, second, status, prompt, completion) in enumerate(rows):
        total = None if prompt is None else prompt + completion
        full.append((str(i), shard, "r", 0, status, None, None, second, second, prompt, completion, total))
    plain = spark.createDataFrame(full, LOG.replace("timestamp", "double"))
    return plain.withColumns({c: F.timestamp_seconds(c) for c in ("started_at", "finished_at")})


@pytest.fixture(scope="module")
def sample(spark):
    rows = [(0, 10.0, "ok", 10, 5), (0, 40.0, "ok", 20, 5), (0, 50.0, "error", None, None)]
    rows += [(0, 190.0, "ok", 30, 10)]  # two empty minutes before
    rows += [(1, 5.0, "error", None, None), (1, 70.0, "ok", 100, 50)]
    return log(spark, rows)


@pytest.fixture(scope="module")
def totals(spark):
    return spark.createDataFrame([(0, 10), (1, 4)], "shard int, total long")


def by_key(frame, *names):
    return {tuple(r[n] for n in ("shard", "timestamp")): tuple(r[n] for n in names) for r in frame.collect()}


def test_empty_intervals_are_reported(spark, sample):
    rows = interval_counts(sample, 60).where("shard = 0").orderBy("bucket").collect()
    assert [(r.bucket, r.new, r.errors, r.total_tokens) for r in rows] == [(0, 2, 1, 40), (1, 0, 0, 0), (2, 0, 0, 0), (3, 1, 0, 40)]


def test_progress_from_first_completion(spark, sample, totals):
    rows = progress(sample, totals, 60, num_shards=2)
    got = by_key(rows, "new", "errors", "completed", "elapsed_seconds", "duration_seconds", "interval_new")
    assert got == {
        (0, 60.0): (2, 1, 3, 50.0, 50.0, 2),
        (0, 120.0): (2, 1, 3, 110.0, 60.0, 0),
        (0, 180.0): (2, 1, 3, 170.0, 60.0, 0),
        (0, 240.0): (3, 1, 4, 230.0, 60.0, 1),
        (1, 120.0): (1, 1, 2, 50.0, 50.0, 1),  # nothing is reported before the first completion
    }
    rates = by_key(rows, "overall_requests_per_second", "interval_requests_per_second", "overall_total_tokens_per_second", "eta_seconds", "eta_formatted")
    assert rates[(0, 60.0)] == (2 / 50, 2 / 50, 40 / 50, 7 / (2 / 50), "2.9m")
    assert rates[(0, 120.0)] == (2 / 110, 0.0, 40 / 110, 0.0, "0.0s")
    assert rates[(0, 240.0)] == (3 / 230, 1 / 60, 80 / 230, 6 / (1 / 60), "6.0m")


def test_progress_from_start_with_existing_rows(spark, sample, totals):
    existing = spark.createDataFrame([(1, 2)], "shard int, existing long")
    rows = progress(sample, totals, 60, origin="start", existing=existing, count_errors=False)
    got = by_key(rows, "new", "completed", "elapsed_seconds")
    assert got[(1, 60.0)] == (0, 2, 55.0) and got[(1, 120.0)] == (1, 3, 115.0)
    with pytest.raises(ValueError):
        progress(sample, totals, origin="noon")


def test_records_have_the_log_schema(spark, sample, totals):
    rows = progress(sample, totals, 60, num_shards=2)
    records = progress_records(rows)
    declared = progress_schema()
    assert records.schema.simpleString() == declared.simpleString()
    first = records.where("shard = 0").orderBy("timestamp").first()
    assert (first.progress.new, first.progress.existing, first.progress.completed) == (2, 1, 3)
    overall = first.throughput.overall
    assert overall.requests_per_hour == overall.requests_per_second * 3600
    assert "overall_total_tokens_per_hour" in per_hour(rows).columns


def test_sums_of_intervals_are_the_totals(spark, sample, totals):
    rows = progress(sample, totals, 60)
    last = rows.groupBy("shard").agg(F.max_by("new", "timestamp").alias("new"), F.sum("interval_new").alias("sum")).collect()
    assert all(r.new == r.sum for r in last)


PROGRESS = (
    "shard int, num_shards int, timestamp double, completed long, total long, new long, existing long, eta_seconds double, "
    "eta_formatted string, overall_requests_ps double, overall_total_tps double, overall_prompt_tps double, overall_completion_tps double"
)


@pytest.fixture(scope="module")
def reports(spark):
    rows = [
        (0, 4, 100.0, 10, 100, 10, 0, 900.0, "15.0m", 1.0, 10.0, 6.0, 4.0),
        (0, 4, 200.0, 30, 100, 30, 0, 700.0, "11.7m", 3.0, 30.0, 16.0, 14.0),
        (1, 4, 150.0, 50, 100, 50, 0, 50.0, "50.0s", 5.0, 50.0, 25.0, 25.0),
        (3, 4, 190.0, 100, 100, 100, 0, 0.0, "0.0s", 2.0, 20.0, 10.0, 10.0),
    ]
    plain = spark.createDataFrame(rows, PROGRESS)
    return plain.withColumn("datetime", F.timestamp_seconds("timestamp"))


def test_current_throughput(reports):
    row = current_throughput(reports, 180.0).first()
    assert tuple(row) == (2, 5.0, 50.0, 26.0, 24.0)
    assert tuple(current_throughput(reports, 999.0).first()) == (0, 0.0, 0.0, 0.0, 0.0)
    assert throughput_board(current_throughput(reports, 0.0)).first().total_tps == "100.0"


def test_shard_stats(reports):
    rows = {r.shard: r for r in shard_stats(reports, 180.0).collect()}
    assert {s: r.status for s, r in rows.items()} == {0: "active", 1: "inactive", 2: "No Data", 3: "active"}
    assert (rows[0].entries, rows[2].entries, rows[0].avg_requests_ps, rows[0].progress_pct) == (2, 0, 2.0, 30.0)
    assert [r.shard for r in shard_stats(reports, 0.0, shards=[3, 1]).orderBy("shard").collect()] == [1, 3]


def test_shard_board(spark, reports):
    completed = spark.createDataFrame([(3,)], "shard int")
    rows = {r.shard: tuple(r)[1:] for r in shard_board(shard_stats(reports, 180.0), completed).collect()}
    assert rows[0] == (False, "30.0%", "2", "active", "2.0", "20.0", "11.0", "9.0", "1970-01-01 00:03:20", "11.7m")
    assert rows[2] == (False, "-", "0", "No Data", "-", "-", "-", "-", "-", "-")
    assert rows[3][0] is True


def test_run_summary(spark, reports):
    completed = spark.createDataFrame([(3,), (2,)], "shard int")
    row = run_summary(reports, completed, 180.0).first()
    assert (row.total_shards, row.shards_completed, row.shards_with_data, row.active_shards) == (4, 2, 3, 2)
    assert (row.total_completed, row.total_requests, row.progress_pct) == (180, 400, 45.0)
    assert row.duration_minutes == 100 / 60 and row.longest_eta == "∞"
    both = spark.createDataFrame([(2,)], "shard int")
    assert run_summary(reports, both, 100.0).first().longest_eta == "11.7m"
    assert run_summary(reports, both, 100.0, strict_eta=True).first().longest_eta == "∞"
    board = {r.field: r.value for r in summary_board(run_summary(reports, both, 100.0)).collect()}
    assert board["Total requests"] == "400" and board["Duration"] == "1.7 minutes" and board["Overall progress"] == "45.0%"


def test_summary_without_eta(spark, reports):
    none = reports.where("shard = 3")
    empty = spark.createDataFrame([], "shard int")
    assert run_summary(none, empty, 0.0, shards=[3]).first().longest_eta == "N/A"


def test_filters_and_latest(reports):
    assert recent(reports, 190.0).count() == 2
    assert only_shards(reports, [0, 1], 4).count() == 3
    with pytest.raises(ValueError):
        only_shards(reports, [4], 4)
    assert {r.shard: r.completed for r in latest_per_shard(reports, "completed").collect()} == {0: 30, 1: 50, 3: 100}


def test_throughput_statistics_and_bars(reports):
    row = throughput_stats(reports, "shard").where("shard = 0").first()
    assert (row.avg_total_tps, row.min_total_tps, row.max_total_tps) == (20.0, 10.0, 30.0)
    bars = {(r.timestamp, r.series): len(r.bar) for r in throughput_bars(reports).where("shard = 0").collect()}
    assert bars[(200.0, "total_tps")] == 50 and bars[(100.0, "total_tps")] == 16 and bars[(100.0, "prompt_tps")] == 10
    assert run_duration(reports).first().duration_minutes == 100 / 60


def test_outcomes_and_usage(spark, sample):
    row = usage_totals(sample).first()
    assert tuple(row) == (4, 160, 70, 230)
    assert tuple(usage_totals(sample.where("status = 'error'")).first()) == (0, 0, 0, 0)
    counts = {r.shard: (r.new, r.errors) for r in outcome_counts(sample, "shard").collect()}
    assert counts == {0: (3, 1), 1: (1, 1)}


def test_completion_counts_an_id_once(spark):
    attempts = [("a", "error"), ("a", "ok"), ("a", "ok"), ("b", "error"), ("b", "aborted"), ("c", "aborted")]
    frame = spark.createDataFrame([(i, 0, s) for i, s in attempts], "id string, shard int, status string")
    source = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0), ("c", 0), ("d", 1)], "id string, shard int")
    rows = {r.shard: r for r in shard_completion(shard_totals(source), frame).collect()}
    assert (rows[0].total, rows[0].succeeded, rows[0].failed, rows[0].aborted, rows[0].complete) == (3, 1, 1, 1, False)
    assert (rows[1].total, rows[1].succeeded, rows[1].complete) == (1, 0, False)
    with pytest.raises(ValueError):
        shard_completion(shard_totals(source), frame, "tried")


def test_status_rows_have_the_flat_columns(sample, totals):
    rows = status_rows(progress(sample, totals, 60, num_shards=2))
    assert shard_stats(rows, 200.0).where("shard = 0").first().status == "active"
