"""Which shards are done, running, failed or still to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Reasons in ledgers of failed shards.
FAILURE_REASONS = (
    "inference_script_failed",
    "data_validation_failed",
    "health_check_failed",
    "inference_server_startup_failed",
    "inference_server_terminated_during_healthcheck",
    "gpu_idle_timeout",
    "manual_cancellation",
    "unexpected_signal",
    "resubmission_failed",
)

def shard_ledger(completion: DataFrame, invalid: DataFrame | None = None) -> DataFrame:
    """State of each shard from `shard_completion`: shard, state, total, succeeded, failed.

    `invalid`, if given, holds the shards whose input did not pass validation.
    """
    rows = completion
    if invalid is not None:
        rows = rows.join(invalid.select("shard", F.lit(True).alias("invalid")).distinct(), "shard", "left")
    else:
        rows = rows.withColumn("invalid", F.lit(None).cast("boolean"))
    state = (
        F.when(F.col("invalid"), "validation_failed")
        .when(F.col("complete"), "complete")
        .when(F.col("aborted") > 0, "breaker_tripped")
        .otherwise("incomplete")
    )
    return rows.select("shard", state.alias("state"), "total", "succeeded", "failed")


def completed_shards(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("state") == "complete").select("shard").distinct()


def write_completed(ledger: DataFrame, path: str) -> None:
    """Completed shards as text, one number per line; appends those not yet listed."""
    from inkwell.sources.ledgers import read_ledger

    done = read_ledger(ledger.sparkSession, path, "completed")
    new = completed_shards(ledger).join(done, "shard", "left_anti")
    new.select(F.col("shard").cast("string").alias("value")).coalesce(1).write.mode("append").text(path)


def all_shards(spark: SparkSession, num_shards: int) -> DataFrame:
    return spark.range(num_shards).select(F.col("id").cast("int").alias("shard"))


def shards_to_submit(num_shards: int, completed: DataFrame, jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """Shards neither completed nor held by an active job, the lowest `limit` of them."""
    rest = (
        all_shards(completed.sparkSession, num_shards)
        .join(jobs.select("shard").distinct(), "shard", "left_anti")
        .join(completed.select("shard").distinct(), "shard", "left_anti")
    )
    return rest.orderBy("shard").limit(limit) if limit else rest


def status_board(num_shards: int, completed: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each shard with its completed flag and the state and id of its last job."""
    job = jobs.groupBy("shard").agg(F.max_by(F.struct("states", "job_id"), "job_id").alias("job"))
    done = completed.select("shard").distinct().withColumn("done", F.lit(True))
    return (
        all_shards(completed.sparkSession, num_shards)
        .join(done, "shard", "left")
        .join(job, "shard", "left")
        .select(
            "shard",
            F.coalesce("done", F.lit(False)).alias("completed"),
            F.coalesce(F.array_join("job.states", ","), F.lit("-")).alias("state"),
            F.coalesce(F.col("job.job_id").cast("string"), F.lit("-")).alias("job_id"),
        )
    )


def job_state_counts(jobs: DataFrame) -> DataFrame:
    """Jobs per state, by the first state of each."""
    return jobs.groupBy(F.get("states", F.lit(0)).alias("state")).agg(F.count(F.lit(1)).alias("num_jobs"))


def failed_lines(ledger: DataFrame, at: str, job: str) -> DataFrame:
    """Ledger lines of failed shards: `shard date time reason job info`."""
    reason = (
        F.when(F.col("state") == "validation_failed", FAILURE_REASONS[1])
        .when(F.col("state").isin("breaker_tripped", "incomplete"), FAILURE_REASONS[0])
    )
    info = F.concat(F.col("state"), F.lit(": "), F.col("succeeded"), F.lit(" of "), F.col("total"), F.lit(" ok"))
    return ledger.where(F.col("state") != "complete").select(
        F.concat_ws(" ", F.col("shard").cast("string"), F.lit(at), reason, F.lit(job), info).alias("value")
    )
