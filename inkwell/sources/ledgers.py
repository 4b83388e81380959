"""Shard ledgers (text) and job snapshots (JSON)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.sharding import base_job_name, shard_of_job
from inkwell.schemas import JOB_SNAPSHOT
from inkwell.sources import files

# The states of a job that still holds its shard.
ACTIVE_JOB_STATES = ("PENDING", "RUNNING", "CONFIGURING", "COMPLETING")

_FAILED_LINE = r"^(\d+) (\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) (\S+) (\S+) ?(.*)$"


def read_ledger(spark: SparkSession, path: str, kind: str = "completed") -> DataFrame:
    """`completed`: distinct shard numbers, one per line. `failed`: one row per failure.

    A missing file is an empty ledger.
    """
    if kind not in ("completed", "failed"):
        raise ValueError("kind must be 'completed' or 'failed'")
    if files.exists(spark, path):
        lines = spark.read.text(path)
    else:
        lines = spark.createDataFrame([], "value string")
    if kind == "completed":
        shard = F.trim("value").try_cast("int")
        return lines.select(shard.alias("shard")).where("shard IS NOT NULL").distinct()
    parts = [F.regexp_extract("value", _FAILED_LINE, i) for i in range(1, 6)]
    return lines.where(F.col("value").rlike(_FAILED_LINE)).select(
        parts[0].cast("int").alias("shard"),
        F.to_timestamp(parts[1], "yyyy-MM-dd HH:mm:ss").alias("failed_at"),
        parts[2].alias("reason"),
        parts[3].alias("job"),
        parts[4].alias("info"),
    )


def job_states(state: Column) -> Column:
    """States as an array, from a plain string or the JSON text of an array."""
    return F.when(state.startswith("["), F.from_json(state, "array<string>")).otherwise(F.array(state))


def is_active(states: Column) -> Column:
    return F.arrays_overlap(states, F.array(*[F.lit(name) for name in ACTIVE_JOB_STATES]))


def normalise_jobs(jobs: DataFrame, job_name: str | None = None, active_only: bool = True) -> DataFrame:
    """name, job_id, shard, states of jobs with columns name, job_id, job_state."""
    out = jobs.select(
        "name", "job_id", shard_of_job("name").alias("shard"), job_states(F.col("job_state")).alias("states")
    )
    if job_name is not None:
        out = out.where(base_job_name("name") == job_name)
    return out.where(is_active(F.col("states"))) if active_only else out


def read_jobs(spark: SparkSession, snapshot: str, job_name: str | None = None, active_only: bool = True) -> DataFrame:
    """Jobs of a `{"jobs": [...]}` snapshot; anything else is an error."""
    raw = spark.read.schema(JOB_SNAPSHOT).option("multiLine", True).option("mode", "PERMISSIVE").json(snapshot)
    if not raw.where("jobs IS NULL").isEmpty():
        raise ValueError(f"{snapshot}: 'jobs' is not a list")
    return normalise_jobs(raw.select(F.inline("jobs")), job_name, active_only)
