"""Live throughput from a stream of request log rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkwell.operators.outcomes import token_sums


def windowed_counts(log: DataFrame, interval: str = "60 seconds", lateness: str = "10 minutes") -> DataFrame:
    """Outcomes and tokens per shard and time window of a streamed request log.

    `lateness` is how far out of order rows may come; later ones are dropped by
    the watermark, and state older than it is freed.
    """
    return (
        log.withWatermark("finished_at", lateness)
        .groupBy(F.window("finished_at", interval).alias("window"), "shard")
        .agg(
            F.count_if(F.col("status") == "ok").alias("new"),
            F.count_if(F.col("status") == "error").alias("errors"),
            *token_sums(),
        )
        .select("shard", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                "new", "errors", "prompt_tokens", "completion_tokens", "total_tokens")
    )


def write_throughput(
    counts: DataFrame, path: str, checkpoint: str, available_now: bool = True, interval: str = "60 seconds"
) -> StreamingQuery:
    """Append each batch's changed windows to a table, with the batch number."""

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        # Named by batch and overwritten, so a repeated batch leaves one copy.
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = counts.writeStream.outputMode("update").foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def read_throughput(spark: SparkSession, path: str) -> DataFrame:
    """The last version of each window."""
    table = spark.read.parquet(path)
    values = ("window_end", "new", "errors", "prompt_tokens", "completion_tokens", "total_tokens")
    return table.groupBy("shard", "window_start").agg(*[F.max_by(name, "batch").alias(name) for name in values])
