"""The bucketed index of done ids."""

import pytest
from pyspark.sql import functions as F

from inkwell.config import RunConfig
from inkwell.operators.client import StubClient
from inkwell.operators.resume import pending
from inkwell.plans.run import run
from inkwell.sinks.compaction import compact
from inkwell.sinks.id_index import IdIndex
from inkwell.sources import files
from inkwell.sources.responses import done_ids, read_results


def config(out, **changes):
    values = dict(api_type="completion", model="m", dataset_path="x", output_path=out, max_connections=8, num_workers=2,
                  num_inference_servers=3)
    return RunConfig(**{**values, **changes})


def prompts(spark, n=60):
    length = F.col("id").cast("int") + 1
    return spark.range(n).select(F.col("id").cast("string").alias("id"), F.repeat(F.lit("x"), length).alias("prompt"))


def ids(frame):
    return sorted({int(r.id) for r in frame.collect()})


def open_index(spark, out, **more):
    return IdIndex(spark, out, "completion", **more)


def test_index_follows_the_table_and_reads_new_files_only(spark, out):
    with open_index(spark, out) as index:
        assert index.refresh() == 0 and ids(index.done()) == []
    run(spark, config(out), StubClient(), prompts(spark, 20))
    with open_index(spark, out) as index:
        first = index.refresh()
        assert first == len(files.list_files(spark, out)) and index.refresh() == 0
        assert ids(index.done()) == list(range(20))
    run(spark, config(out), StubClient(fail=lambda n: "This model has a maximum context length" if n > 30 else None), prompts(spark, 40))
    with open_index(spark, out) as index:
        assert index.refresh() == len(files.list_files(spark, out)) - first
        assert ids(index.done()) == ids(done_ids(read_results(spark, out, "completion"))) == list(range(40))
        assert ids(index.done(retry_failed=True)) == list(range(30))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("inkwell_ids")]


@pytest.mark.parametrize("buckets", [8, 40])
def test_join_moves_the_input_only(spark, out, buckets):
    run(spark, config(out), StubClient(), prompts(spark, 30))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with open_index(spark, out, buckets=buckets) as index:
            index.refresh()
            rest = pending(prompts(spark), index.done())
            plan = rest._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange") == 1 and "LeftAnti" in plan
            scan = plan.split("FileScan")[1]
            assert "Bucketed: true" in scan and "Exchange" not in scan and f"out of {buckets}" in scan
            assert ids(rest) == list(range(30, 60))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_runs_with_the_index_answer_each_row_once(spark, out):
    run(spark, config(out), StubClient(), prompts(spark, 25), resume_index=True)
    run(spark, config(out), StubClient(), prompts(spark), num_waves=3, resume_index=True)
    counts = read_results(spark, out, "completion").groupBy("id").count().collect()
    assert len(counts) == 60 and {r["count"] for r in counts} == {1}
    # compacted files have new names: indexed again, and nothing is asked twice
    compact(spark, out, max_files=1)
    summary = run(spark, config(out), StubClient(), prompts(spark), resume_index=True)
    assert summary.new == 0


def test_a_stop_between_ids_and_list_leaves_ids_twice_only(spark, out):
    run(spark, config(out), StubClient(), prompts(spark, 10))
    with open_index(spark, out) as index:
        index.refresh()
        files.delete_folder(spark, f"{out}/_ids/files")  # as if it had stopped before the list was written
        assert index.refresh() > 0
        assert ids(index.done()) == list(range(10)) and index.done().count() == 20
        assert pending(prompts(spark, 12), index.done()).count() == 2
