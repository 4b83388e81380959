"""Progress records written as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from inkwell.functions.formatting import epoch_timestamp
from inkwell.schemas import progress_schema
from inkwell.session import materialize
from inkwell.sources import files

_BAD = "_corrupt_record"


def flatten_progress(records: DataFrame) -> DataFrame:
    """Nested progress records as flat columns."""
    overall = F.col("throughput.overall")
    progress = F.col("progress")
    return records.select(
        "shard",
        "num_shards",
        "timestamp",
        epoch_timestamp("timestamp").alias("datetime"),
        progress["completed"].alias("completed"),
        progress["total"].alias("total"),
        progress["new"].alias("new"),
        progress["existing"].alias("existing"),
        progress["eta_seconds"].cast("double").alias("eta_seconds"),
        progress["eta_formatted"].alias("eta_formatted"),
        overall["requests_per_second"].alias("overall_requests_ps"),
        overall["total_tokens_per_second"].alias("overall_total_tps"),
        overall["prompt_tokens_per_second"].alias("overall_prompt_tps"),
        overall["completion_tokens_per_second"].alias("overall_completion_tps"),
    )


def read_progress_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Nested records with the source file and, for a bad line, its text.

    Absent paths are passed over; names with wildcards are left to the reader.
    """
    listed = [paths] if isinstance(paths, str) else list(paths)
    paths = [p for p in listed if any(c in p for c in "*?[{") or files.exists(spark, p)]
    schema = StructType([*progress_schema().fields, StructField(_BAD, StringType())])
    if not paths:
        return spark.createDataFrame([], schema).withColumn("file", F.lit(None).cast("string"))
    return (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _BAD)
        .json(paths)
        .withColumn("file", F.col("_metadata.file_path"))
    )


def progress_file_report(records: DataFrame) -> DataFrame:
    """Good and bad lines per file."""
    return records.groupBy("file").agg(
        F.count_if(F.col(_BAD).isNull()).alias("good_lines"),
        F.count_if(F.col(_BAD).isNotNull()).alias("bad_lines"),
    )


def read_progress(spark: SparkSession, paths: str | list[str], skip: str = "file") -> DataFrame:
    """Flat progress rows of many files.

    A file with a line that cannot be read is left out whole (`skip="file"`), or
    just its bad lines are (`skip="line"`). No good row at all is an error.
    """
    if skip not in ("file", "line"):
        raise ValueError("skip must be 'file' or 'line'")
    # Parsed once: bad lines cannot be asked for in a plan that reads no other column of the text.
    records = materialize(read_progress_records(spark, paths), "progress-records")
    good = records.where(F.col(_BAD).isNull())
    if skip == "file":
        bad_files = records.where(F.col(_BAD).isNotNull()).select("file").distinct()
        good = good.join(bad_files, "file", "left_anti")
    flat = flatten_progress(good)
    if flat.isEmpty():
        raise ValueError("no valid progress record could be loaded")
    return flat
