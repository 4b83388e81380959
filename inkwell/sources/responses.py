"""Reading what earlier runs wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inkwell.operators.client import RETRY_STATUSES
from inkwell.schemas import response_ddl, results_schema
from inkwell.sources import files


_STORES_STATUS: dict[str, bool] = {}


def _stores_status(spark: SparkSession, file: str) -> bool:
    """Whether a results file has the status column; files never change, so each is asked once."""
    if file not in _STORES_STATUS:
        if len(_STORES_STATUS) > 1000:
            _STORES_STATUS.clear()
        _STORES_STATUS[file] = "http_status" in spark.read.parquet(file).columns
    return _STORES_STATUS[file]


def read_results(
    spark: SparkSession, path: str, api_type: str = "chat-completion", only: list[str] | None = None
) -> DataFrame:
    """The results table, one row per attempt; an absent path is an empty table. `only`: some of its files.

    A compaction that was stopped half-way is finished first. Of a table written before the HTTP status had a column of its own, the status is taken from the error texts.
    """
    from inkwell.sinks.compaction import finish_open  # it reads inventories, which read tables

    schema = results_schema(api_type)
    finish_open(spark, path)
    first = files.first_file(spark, path)
    if first is None:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema).option("pathGlobFilter", "*.parquet")
    rows = reader.parquet(path) if only is None else reader.option("basePath", path).parquet(*only)
    if _stores_status(spark, first):
        return rows
    return rows.withColumn("http_status", status_in(F.col("error_text")))


def read_response_files(spark: SparkSession, path: str, api_type: str = "chat-completion") -> DataFrame:
    """Files of plain (id, response) rows, `shardNNNNNN_*.parquet`, checkpoints and parts alike.

    The shard comes from the file name. Unfinished files do not end in `.parquet`
    and are left out. An absent path is an empty table.
    """
    schema = StructType.fromDDL(f"id string, response {response_ddl(api_type)}")
    if not files.has_file(spark, path):
        return spark.createDataFrame([], schema).withColumn("shard", F.lit(None).cast("int"))
    df = (
        spark.read.schema(schema)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet")
        .parquet(path)
    )
    number = F.regexp_extract(F.col("_metadata.file_name"), r"^shard(\d{6,})", 1)
    return df.withColumn("shard", number.try_cast("int"))


def finished(rows: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Attempts after which an id needs no further request.

    Those with a response, and those whose prompt is too long for the model,
    which no retry can mend, unless `retry_failed` is set. The HTTP status decides over the words of the
    error: a rate limit may speak of too many tokens.
    """
    done = F.col("status") == "ok"
    if not retry_failed:
        status = F.col("http_status")
        passing = F.coalesce(status.isin(*RETRY_STATUSES) | (status >= 500), F.lit(False))
        done = done | ((F.col("error_class") == "context_length") & ~passing)
    return rows.where(done)


def status_in(error_text: Column) -> Column:
    """The HTTP status at the start of an error text."""
    return F.regexp_extract(error_text, r"^(?:Error code: )?(\d{3})\b", 1).try_cast("int")


def done_ids(results: DataFrame, retry_failed: bool = False, shard: int | None = None) -> DataFrame:
    """Distinct ids that need no further request, of a results table or of plain response rows.

    Reads only the id and the three status columns; `shard` prunes partitions.
    """
    if shard is not None:
        results = results.where(F.col("shard") == shard)
    if "status" in results.columns:
        results = finished(results, retry_failed)
    return results.select("id").distinct()
