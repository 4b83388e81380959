"""Writing result, progress and prepared tables; what files a table has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.sharding import hash_shard
from inkwell.sinks.task_files import append_task_files
from inkwell.sources import files

SHARD_FOLDER = r"/shard=(\d+)/[^/]*$"
SHARD_FILE = r"/shard(\d{6,})[^/]*$"


def append_results(
    results: DataFrame, path: str, max_rows_per_file: int | None = None, keep_finished: bool = False
) -> None:
    """Append to a zstd parquet table with one folder per shard.

    The frame is written as it is partitioned; `infer` gives each task one shard. With `keep_finished`, the files of
    finished tasks stay when the job fails, in stores that tasks can reach themselves (`inkwell.sinks.task_files`).
    """
    if keep_finished and append_task_files(results, path, by="shard", max_rows=max_rows_per_file):
        return
    writer = results.write.mode("append").partitionBy("shard").option("compression", "zstd")
    if max_rows_per_file:
        writer = writer.option("maxRecordsPerFile", max_rows_per_file)
    writer.parquet(path)


def export_responses(answers: DataFrame, path: str) -> None:
    """Write plain (id, response) files, without attempts that failed or repeat."""
    answers.select("id", "response").write.option("compression", "zstd").parquet(path)


def adopt_responses(answers: DataFrame, path: str, num_shards: int) -> None:
    """Append plain (id, response) rows to a results table, as successful attempts.

    A run on that table then resumes after them. The rebalance hint gives each
    shard folder files of even size and cuts a large shard into several.
    """
    created = F.timestamp_seconds(F.col("response.created"))
    rows = answers.select(
        "id",
        F.lit("adopted").alias("run_id"),
        F.lit(0).alias("wave"),
        F.lit("ok").alias("status"),
        F.lit(None).cast("string").alias("error_class"),
        F.lit(None).cast("string").alias("error_text"),
        F.lit(None).cast("int").alias("http_status"),
        created.alias("started_at"),
        created.alias("finished_at"),
        "response",
        hash_shard("id", num_shards).alias("shard"),
    )
    append_results(rows.hint("rebalance", "shard"), path)


def save_prepared(df: DataFrame, path: str) -> None:
    """Save an input table once its prompts or conversations are built."""
    df.write.option("compression", "zstd").parquet(path)


def append_progress(records: DataFrame, path: str) -> None:
    """Append nested progress records as JSON lines. Earlier history is kept."""
    records.write.mode("append").json(path)


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """shard, file_path, num_bytes and num_rows of every file of an output table.

    Rows are counted from the file footers. Works for shard folders and for
    `shardNNNNNN_*.parquet` files.
    """
    empty = "shard int, file_path string, num_bytes bigint, num_rows bigint"
    if not files.has_file(spark, path):
        return spark.createDataFrame([], empty)
    table = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(path)
    )
    file_path = F.col("_metadata.file_path")
    counts = table.groupBy(file_path.alias("file_path"), F.col("_metadata.file_size").alias("num_bytes")).agg(
        F.count(F.lit(1)).alias("num_rows")
    )
    shard = F.coalesce(
        F.regexp_extract("file_path", SHARD_FOLDER, 1).try_cast("int"),
        F.regexp_extract("file_path", SHARD_FILE, 1).try_cast("int"),
    )
    return counts.select(shard.alias("shard"), "file_path", "num_bytes", "num_rows")
