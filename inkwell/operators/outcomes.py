"""Counts of outcomes and tokens, and whether shards are complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.errors import API, CONTEXT_LENGTH, OTHER, TIMEOUT

TOKENS = ("prompt_tokens", "completion_tokens", "total_tokens")


def request_log(results: DataFrame) -> DataFrame:
    """The narrow view of a results table: everything but the response texts."""
    usage = F.col("response.usage")
    return results.select(
        "id",
        "shard",
        "run_id",
        "wave",
        "status",
        "error_class",
        "error_text",
        *[c for c in ("http_status",) if c in results.columns],
        "started_at",
        "finished_at",
        *[usage[name].alias(name) for name in TOKENS],
    )


def token_sums() -> list[Column]:
    """Token totals; rows without usage count as zero."""
    return [F.coalesce(F.sum(F.col(name).cast("bigint")), F.lit(0)).alias(name) for name in TOKENS]


def usage_totals(log: DataFrame, *by: str) -> DataFrame:
    """Requests with a response and their tokens, in all or by some columns."""
    ok = log.where(F.col("status") == "ok")
    return ok.groupBy(*by).agg(F.count(F.lit(1)).alias("requests"), *token_sums())


def outcome_counts(log: DataFrame, *by: str) -> DataFrame:
    """New responses, errors by class and unsent rows."""
    failed = F.col("status") == "error"
    counts = [
        F.count_if(F.col("status") == "ok").alias("new"),
        F.count_if(failed).alias("errors"),
        *[F.count_if(failed & (F.col("error_class") == c)).alias(f"{c}_errors") for c in (TIMEOUT, CONTEXT_LENGTH, API, OTHER)],
        F.count_if(F.col("status") == "aborted").alias("aborted"),
    ]
    return log.groupBy(*by).agg(*counts)


def id_counts(rows: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows, distinct ids and surplus rows of an output table."""
    per_id = rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    return per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("num_rows"),
        F.count(F.lit(1)).alias("num_ids"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus_rows"),
    )


def shard_totals(df: DataFrame, id_col: str = "id", shard_col: str = "shard") -> DataFrame:
    """Distinct ids per shard of an input with a shard column: shard, total."""
    ids = df.groupBy(shard_col, id_col).agg(F.count(F.lit(1)).alias("n"))
    return ids.groupBy(F.col(shard_col).alias("shard")).agg(F.count(F.lit(1)).alias("total"))


def shard_completion(totals: DataFrame, log: DataFrame, completion: str = "attempted") -> DataFrame:
    """Per shard: total, succeeded, failed, aborted, complete, success_ratio.

    An id counts once, by its best outcome. `attempted` takes failed ids as done,
    `succeeded` does not.
    """
    if completion not in ("attempted", "succeeded"):
        raise ValueError("completion must be 'attempted' or 'succeeded'")
    per_id = log.groupBy("shard", "id").agg(
        F.bool_or(F.col("status") == "ok").alias("ok"), F.bool_or(F.col("status") == "error").alias("failed")
    )
    per_shard = per_id.groupBy("shard").agg(
        F.count_if("ok").alias("succeeded"),
        F.count_if(~F.col("ok") & F.col("failed")).alias("failed"),
        F.count_if(~F.col("ok") & ~F.col("failed")).alias("aborted"),
    )
    zero = F.lit(0)
    joined = totals.join(per_shard, "shard", "left").select(
        "shard",
        "total",
        *[F.coalesce(name, zero).alias(name) for name in ("succeeded", "failed", "aborted")],
    )
    done = F.col("succeeded") + F.col("failed") if completion == "attempted" else F.col("succeeded")
    return joined.select(
        "*",
        (done >= F.col("total")).alias("complete"),
        F.coalesce(F.try_divide("succeeded", "total"), F.lit(1.0)).alias("success_ratio"),
    )


def check_complete(
    totals: DataFrame, log: DataFrame, completion: str = "attempted", min_success_ratio: float = 0.0
) -> None:
    """Raise, naming the shards, if any is incomplete or succeeded too rarely."""
    status = shard_completion(totals, log, completion)
    bad = status.where(~F.col("complete") | (F.col("success_ratio") < min_success_ratio))
    shown = bad.orderBy("shard").limit(20).collect()
    if shown:
        more = bad.count() - len(shown)
        raise IncompleteShardsError(
            "; ".join(f"shard {r.shard}: {r.succeeded} ok, {r.failed} failed of {r.total}" for r in shown)
            + (f"; and {more} more shards" if more else "")
        )


class IncompleteShardsError(RuntimeError):
    """Some shards have rows without an outcome, or too few responses."""
