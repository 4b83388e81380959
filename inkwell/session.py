"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Requests are slow and must not be sent twice: no speculative copies of a task,
# and small Arrow batches, so finished rows leave the task early. Task retries stay
# on: a request task never fails by itself, only with its executor.
STATIC_CONF = {
    "spark.speculation": "false",
    # Recording the call site of every column expression slows plan building.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    # A request task writes one shard, so no sort by shard is needed before the write.
    "spark.sql.maxConcurrentOutputFileWriters": "16",
}


def build_session(app_name: str = "inkwell", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library is designed for."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**STATIC_CONF, **RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, as `spark.checkpoint.dir` names it.

    A machine-local folder is used only in local mode with the setting absent.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="inkwell-"))
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; never reused, so nothing is overwritten."""
    return f"{work_dir(spark)}/inkwell/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, *partition_by: str, path: str | None = None) -> DataFrame:
    """Write `df` once as a parquet table in the shared folder and read it back.

    Cuts the lineage: later jobs, and retries after a lost executor, start from
    the table, so values that depend on task placement cannot change.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
