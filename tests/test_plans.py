"""The shape of the physical plans that scale depends on."""

import json

import pytest
from pyspark.sql import functions as F

from inkwell.config import RunConfig
from inkwell.functions.parsing import content
from inkwell.operators.client import StubClient
from inkwell.operators.infer import infer
from inkwell.operators.outcomes import request_log, usage_totals
from inkwell.operators.resume import pending
from inkwell.operators.responses import join_back, latest_per_id
from inkwell.operators.shard import with_shard
from inkwell.operators.status import shard_stats
from inkwell.operators.transforms import apply_named
from inkwell.operators.validate import validate
from inkwell.schemas import results_schema
from inkwell.session import materialize, scratch_path, work_dir
from inkwell.sources.responses import done_ids, read_results


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def table(spark, out):
    rows = spark.range(100).select(F.col("id").cast("string").alias("id"), F.lit("t").alias("text"), F.lit("en").alias("lang"))
    rows.write.parquet(out)
    return spark.read.parquet(out)


@pytest.fixture
def results(spark, tmp_path):
    path = str(tmp_path / "results")
    empty = spark.createDataFrame([], results_schema("chat-completion"))
    one = empty.union(
        spark.sql("SELECT 'a' id, 'r' run_id, 0 wave, 'ok' status, null error_class, null error_text, CAST(null AS INT) http_status, now() started_at, now() finished_at").select(
            "*", F.lit(None).cast(empty.schema["response"].dataType).alias("response"), F.lit(0).alias("shard")
        )
    )
    one.write.partitionBy("shard").parquet(path)
    return read_results(spark, path)


def test_request_map_has_one_shuffle_before_it_and_none_after(spark, table):
    config = RunConfig(
        api_type="chat-completion", model="m", dataset_path="x", output_path="x", max_connections=8, num_inference_servers=2,
        input_column_name="messages", apply_udf="template_messages", apply_udf_kwargs={"template": "{document}"},
    )
    rows = apply_named(table, config.apply_udf, config.apply_udf_kwargs)
    text = plan(infer(rows, config, StubClient()))
    assert text.count("MapInArrow") == 1
    above, below = text.split("MapInArrow", 1)
    assert "Exchange" not in above and below.count("Exchange") == 1
    assert "shufflepartitionidpassthrough" in below
    assert "ReadSchema: struct<id:string,text:string>" in below


def test_validation_is_one_pass_without_a_data_shuffle(table):
    text = plan(validate(table, "completion", "text"))
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1
    assert "Exchange SinglePartition" in text  # one partial row per task


def test_hash_shards_move_nothing(table):
    assert "Exchange" not in plan(with_shard(table, 8))


def test_stored_blocks_move_only_file_counts(table):
    text = plan(with_shard(table, 8, "contiguous"))
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text


def test_resume_reads_ids_and_the_three_status_columns_of_the_results(results):
    text = plan(done_ids(results))
    assert "ReadSchema: struct<id:string,status:string,error_class:string,http_status:int>" in text
    pruned = plan(done_ids(results, shard=3))
    assert "isnotnull(shard" in pruned.split("PartitionFilters:")[1].split("]")[0]


def test_resume_is_an_anti_join_without_a_forced_broadcast(spark, table):
    done = table.select("id").distinct()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" in plan(pending(table, done)) and "LeftAnti" in plan(pending(table, done))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan(pending(table, table.select("id")))


def test_last_row_per_id_is_cut_down_before_the_shuffle(table):
    text = plan(latest_per_id(table, "lang", ("id",)))
    above, below = text.split("Exchange", 1)
    assert "Final" in above and "WindowGroupLimit" in below and "Partial" in below


def test_nested_reads_scan_their_leaves_only(results):
    text = plan(results.select(content()))
    assert "ReadSchema: struct<response:struct<choices:array<struct<message:struct<content:string>>>>>" in text
    usage = plan(usage_totals(request_log(results)))
    assert "choices" not in usage.split("ReadSchema:")[1]


def test_joining_back_shuffles_parsed_values_only(spark, table, results):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(join_back(table.select("id"), results, columns={"n": F.length(content())}))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "text" not in text.split("ReadSchema:")[1].split("\n")[0]
    assert "length" in text and text.index("SortMergeJoin") < text.index("length")


def test_status_needs_no_sort_merge_join(spark, out):
    names = "shard int, num_shards int, timestamp double, datetime timestamp, completed long, total long, eta_seconds double, eta_formatted string, overall_requests_ps double, overall_total_tps double, overall_prompt_tps double, overall_completion_tps double"
    spark.createDataFrame([], names).write.parquet(out)
    assert "CartesianProduct" not in plan(shard_stats(spark.read.parquet(out), 0.0, num_shards=4))


def test_materialized_frames_have_no_lineage(spark, table):
    back = materialize(table.repartition(3), "probe")
    assert "Exchange" not in plan(back) and back.count() == 100
    assert all(work_dir(spark).removeprefix("file:") in f for f in back.inputFiles())
    assert scratch_path(spark, "a") != scratch_path(spark, "a")


class Fake:
    """As much of a session as `work_dir` looks at."""

    def __init__(self, setting, master):
        self.conf = {"spark.checkpoint.dir": setting} if setting else {}
        self.sparkContext = self
        self.master = master

    def getCheckpointDir(self):
        return None


def test_work_dir_follows_the_setting():
    assert work_dir(Fake("hdfs://nn/shared/", "yarn")) == "hdfs://nn/shared"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        work_dir(Fake(None, "yarn"))


def test_registered_queries_are_json_safe():
    from inkwell.plans.catalog import ORACLES

    assert json.loads(json.dumps(ORACLES)) == ORACLES
