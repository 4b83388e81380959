"""Runs of consecutive failures in a request log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.functions.errors import BREAKER_CLASSES
from inkwell.operators.ordering import ordered_chunks


def failure_streaks(
    log: DataFrame, by: tuple[str, ...] = ("shard",), order: tuple[str, ...] = ("finished_at", "id"), chunks: int | None = None
) -> DataFrame:
    """Counted failures with the length of the streak they are in so far.

    A success ends a streak, errors of other classes leave it as it is. The log
    is cut into range chunks of (by, order), so a shard with most of the rows is
    spread over many tasks. Streaks are counted inside chunks, then what each
    chunk carries into the next one is summed over one row per chunk.
    """
    success = F.col("status") == "ok"
    failure = (F.col("status") == "error") & F.col("error_class").isin(*BREAKER_CLASSES)
    counted = log.select(
        *by, *order, success.alias("_success"), F.coalesce(failure, F.lit(False)).cast("int").alias("_failure")
    ).where("_success OR _failure = 1")
    chunked = ordered_chunks(counted, [*by, *order], chunks)

    inside = W.partitionBy(*by, "chunk").orderBy("chunk_pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    running = chunked.withColumn("_failures", F.sum("_failure").over(inside)).withColumn(
        "_at_success", F.max(F.when(F.col("_success"), F.col("_failures"))).over(inside)
    )
    ends = running.groupBy(*by, "chunk").agg(
        (F.max("_failures") - F.coalesce(F.max("_at_success"), F.lit(0))).alias("_tail"),
        F.bool_or("_success").cast("int").alias("_has_success"),
    )
    in_order = W.partitionBy(*by).orderBy("chunk")
    grouped = ends.withColumn("_group", F.sum("_has_success").over(in_order))
    same_group = W.partitionBy(*by, "_group").orderBy("chunk").rowsBetween(W.unboundedPreceding, W.currentRow)
    carried = grouped.withColumn("_sum", F.sum("_tail").over(same_group)).select(
        *by, "chunk", F.coalesce(F.lag("_sum").over(in_order), F.lit(0)).alias("_carry")
    )
    streak = F.when(F.col("_at_success").isNull(), F.col("_failures") + F.col("_carry")).otherwise(
        F.col("_failures") - F.col("_at_success")
    )
    return (
        running.where("_failure = 1").join(carried, [*by, "chunk"]).select(*by, *order, streak.alias("streak"))
    )


def breaker_trips(log: DataFrame, n: int = 20, by: tuple[str, ...] = ("shard",), chunks: int | None = None) -> DataFrame:
    """The first failure of each group at which the streak reached `n`."""
    reached = failure_streaks(log, by, chunks=chunks).where(F.col("streak") >= n)
    first = reached.groupBy(*by).agg(F.min(F.struct("finished_at", "id")).alias("first"))
    return first.select(*by, F.col("first.finished_at").alias("tripped_at"), F.col("first.id").alias("id"))


def longest_streaks(log: DataFrame, by: tuple[str, ...] = ("shard",), chunks: int | None = None) -> DataFrame:
    return failure_streaks(log, by, chunks=chunks).groupBy(*by).agg(F.max("streak").alias("longest_streak"))
