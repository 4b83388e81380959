import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from inkwell.operators.breaker import breaker_trips
from inkwell.operators.progress import progress, report_rows
from inkwell.streaming.state import INTERVALS, TRIPS, first_trips, running_intervals, write_stream
from inkwell.config import RunConfig
from inkwell.operators.client import StubClient
from inkwell.sources.responses import read_results
from inkwell.streaming.annotate import annotate_stream, read_arrivals
from inkwell.streaming.throughput import read_throughput, windowed_counts, write_throughput

SCHEMA = "id string, prompt string"


def add(spark, folder, first, last):
    rows = spark.range(first, last).select(F.col("id").cast("string").alias("id"), F.lit("p").alias("prompt"))
    rows.coalesce(1).write.mode("append").parquet(folder)


def annotate(spark, folder, out, state, **kw):
    config = RunConfig(api_type="completion", model="m", dataset_path="x", output_path=out, max_connections=4, num_workers=2)
    stream = read_arrivals(spark, folder, SCHEMA, max_files_per_trigger=1)
    annotate_stream(stream, config, StubClient(), state, **kw).awaitTermination()
    return read_results(spark, out, "completion")


def test_arriving_files_are_annotated_once(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    add(spark, folder, 0, 10)
    assert annotate(spark, folder, out, state).count() == 10
    assert annotate(spark, folder, out, state).count() == 10  # nothing new
    add(spark, folder, 5, 15)  # five ids are known
    rows = annotate(spark, folder, out, state)
    assert sorted(int(r.id) for r in rows.collect()) == list(range(15))


def test_a_repeated_batch_sends_nothing_twice(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    add(spark, folder, 0, 10)
    annotate(spark, folder, out, str(tmp_path / "s1"), done_scope="batch")
    # A lost checkpoint: the same batch number comes again.
    rows = annotate(spark, folder, out, str(tmp_path / "s2"), done_scope="batch")
    assert rows.count() == 10


def test_throughput_windows(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def log(first, last):
        return spark.range(first, last).select(
            (F.col("id") % 2).cast("int").alias("shard"),
            F.timestamp_seconds(F.col("id") * 10).alias("finished_at"),
            F.when(F.col("id") % 5 == 0, "error").otherwise("ok").alias("status"),
            *[F.when(F.col("id") % 5 != 0, F.lit(n)).alias(c) for c, n in (("prompt_tokens", 2), ("completion_tokens", 1), ("total_tokens", 3))],
        )

    for part in ((0, 20), (15, 40)):
        log(*part).coalesce(1).write.mode("append").parquet(folder)
        schema = spark.read.parquet(folder).schema
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        write_throughput(windowed_counts(stream, "60 seconds", "1 hour"), out, state).awaitTermination()
    want = log(0, 20).union(log(15, 40)).groupBy("shard", F.window("finished_at", "60 seconds").alias("w")).agg(
        F.count_if(F.col("status") == "ok").alias("new"), F.sum("total_tokens").alias("t")
    )
    expected = sorted((r.shard, r.w.start, r.new, r.t or 0) for r in want.collect())
    got = sorted((r.shard, r.window_start, r.new, r.total_tokens) for r in read_throughput(spark, out).collect())
    assert got == expected
    assert len(os.listdir(out)) >= 2


def test_rows_not_sent_are_sent_after_a_restart(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    add(spark, folder, 0, 50)
    config = RunConfig(
        api_type="completion", model="m", dataset_path="x", output_path=out, max_connections=1, num_workers=1,
        max_consecutive_failures=3,
    )

    def start(client):
        stream = read_arrivals(spark, folder, SCHEMA, max_files_per_trigger=1)
        return annotate_stream(stream, config, client, state)

    with pytest.raises(StreamingQueryException, match="rows not sent"):
        start(StubClient(fail=lambda n: "Connection refused")).awaitTermination()
    before = read_results(spark, out, "completion")
    assert before.where("status = 'ok'").count() == 0 and before.where("status = 'aborted'").count() > 0
    start(StubClient()).awaitTermination()
    answered = read_results(spark, out, "completion").where("status = 'ok'")
    assert sorted(int(r.id) for r in answered.collect()) == list(range(50))


def test_a_row_without_an_id_becomes_an_error(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    add(spark, folder, 0, 3)
    spark.createDataFrame([(None, "p")], SCHEMA).write.mode("append").parquet(folder)
    rows = annotate(spark, folder, out, state).collect()
    assert sorted((r.status, r.error_text) for r in rows if r.id is None) == [("error", "not sent: the row has no id")]
    assert sum(r.status == "ok" for r in rows) == 3


def _random_log(spark, seed, hours):
    import random

    rng = random.Random(seed)
    rows = []
    for i in range(150):
        second = rng.choice(hours) * 3600 + rng.randrange(3600)
        status = rng.choice(["ok", "error", "error"])
        kind = rng.choice(["api", "timeout", "other"]) if status == "error" else None
        tokens = rng.randrange(50) if status == "ok" else None
        rows.append((f"{seed}-{i:03d}", rng.randrange(3), status, kind, float(second), tokens))
    plain = spark.createDataFrame(rows, "id string, shard int, status string, error_class string, finished_at double, n int")
    return plain.select(
        "id", "shard", "status", "error_class", F.timestamp_seconds("finished_at").alias("finished_at"),
        *[F.col("n").alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")],
    )


def test_state_survives_a_restart_and_equals_the_batch_reports(spark, tmp_path):
    """Two starts on one checkpoint, hours without rows between them, rows up to two hours late."""
    folder, reports, trips = (str(tmp_path / name) for name in ("in", "reports", "trips"))
    parts = [_random_log(spark, 1, [1, 2]), _random_log(spark, 2, [2, 3, 9]), _random_log(spark, 3, [8, 10])]
    end = parts[0].limit(1).withColumns({"finished_at": F.timestamp_seconds(F.lit(4_000_000.0)), "shard": F.lit(-1)})
    for part in ([parts[0], parts[1]], [parts[2], end]):
        for rows in part:
            rows.coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)
        write_stream(running_intervals(stream, 3600, "2 hours").where("shard >= 0"), reports, str(tmp_path / "a")).awaitTermination()
        write_stream(first_trips(stream, 4, 3600, "2 hours").where("shard >= 0"), trips, str(tmp_path / "b")).awaitTermination()
    log = parts[0].unionByName(parts[1]).unionByName(parts[2])
    totals = log.groupBy("shard").agg(F.count("*").alias("total"))
    rows = spark.read.schema(INTERVALS).parquet(reports).withColumn("origin", F.col("first_ok"))
    got, want = report_rows(rows, totals, 3600), progress(log, totals, 3600)
    columns = [c for c in want.columns if c in got.columns]
    assert sorted(got.select(columns).collect()) == sorted(want.select(columns).collect()) and "eta_seconds" in columns
    found = spark.read.schema(TRIPS).parquet(trips).select("shard", "tripped_at", "id").collect()
    assert sorted(found) == sorted(breaker_trips(log, 4).select("shard", "tripped_at", "id").collect()) and found


def test_batches_look_into_the_index(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    add(spark, folder, 0, 10)
    add(spark, folder, 5, 15)  # five ids again
    assert annotate(spark, folder, out, state, done_scope="index").count() == 15
    add(spark, folder, 10, 20)
    rows = annotate(spark, folder, out, state, done_scope="index")
    assert sorted(int(r.id) for r in rows.collect()) == list(range(20))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("inkwell_ids")]


def test_arriving_files_and_batches_have_a_bound(spark, tmp_path, monkeypatch):
    from inkwell.plans.catalog import answers

    monkeypatch.setattr(answers, "ARRIVAL_ROWS", 10)
    for rows, files, per_batch in ((1000, 100, 16), (40, 4, 2), (2, 2, 1)):
        folder = str(tmp_path / f"arrivals{rows}")
        docs = spark.range(0, rows, 1, 1).select(F.col("id").cast("string").alias("id"), F.lit("x").alias("text"))
        assert answers._save_arrivals(docs, folder) == per_batch
        sizes = [r["count"] for r in spark.read.parquet(folder).groupBy("_metadata.file_name").count().collect()]
        assert len(sizes) == files and max(sizes) <= 10 and sum(sizes) == rows
