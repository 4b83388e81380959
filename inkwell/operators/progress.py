"""Progress over time, computed from a request log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.functions.formatting import format_duration
from inkwell.operators.outcomes import TOKENS
from inkwell.schemas import RATE_NAMES

MICROS = 1_000_000
ORIGINS = ("first_completion", "start")


def _rate(amount: str, seconds: str) -> str:
    return f"CASE WHEN {seconds} > 0 THEN {amount} / {seconds} ELSE 0D END"


def interval_counts(log: DataFrame, interval_s: int = 60, fill_gaps: bool = True) -> DataFrame:
    """Outcomes and tokens per shard and interval, without gaps unless `fill_gaps` is off.

    The only step that reads the whole log; it aggregates before its shuffle.
    Intervals are whole multiples of `interval_s` since the epoch. Those without
    a request, between a shard's first and last, are added as zeros; turn that off for a log of
    several runs, whose idle time would be filled too. A row without an end counts at its start.
    """
    ok = F.col("status") == "ok"
    micros = F.unix_micros("finished_at")
    started = F.unix_micros("started_at") if "started_at" in log.columns else micros
    micros = F.coalesce(micros, started)
    counts = log.groupBy("shard", F.call_function("div", micros, F.lit(interval_s * MICROS)).alias("bucket")).agg(
        F.count_if(ok).alias("new"),
        F.count_if(F.col("status") == "error").alias("errors"),
        *[F.coalesce(F.sum(F.when(ok, F.col(name).cast("bigint"))), F.lit(0)).alias(name) for name in TOKENS],
        F.min(F.when(ok, micros)).alias("first_ok"),
        F.min(started).alias("first_start"),
    )
    if not fill_gaps:
        return counts
    # Each interval stands for itself and the empty ones up to the next.
    following = F.lead("bucket").over(W.partitionBy("shard").orderBy("bucket"))
    filled = counts.withColumn("_until", F.coalesce(following, F.col("bucket") + 1) - 1).select(
        "*", F.explode(F.sequence("bucket", "_until")).alias("_bucket")
    )
    own = F.col("_bucket") == F.col("bucket")
    zeros = [F.when(own, F.col(name)).otherwise(F.lit(0)).alias(name) for name in ("new", "errors", *TOKENS)]
    return filled.select("shard", F.col("_bucket").alias("bucket"), *zeros, "first_ok", "first_start")


def progress(
    log: DataFrame,
    totals: DataFrame,
    interval_s: int = 60,
    origin: str = "first_completion",
    num_shards: int | None = None,
    existing: DataFrame | None = None,
    count_errors: bool = True,
    fill_gaps: bool = True,
) -> DataFrame:
    """One row per shard and report interval, as a run would report it.

    `totals` has shard and total; `existing`, if given, shard and existing (rows
    that already had a response). Overall rates run from the first completion or
    from the first request's start. Completed rows include failed ones unless
    `count_errors` is off. Windows run over intervals, not over requests.
    """
    if origin not in ORIGINS:
        raise ValueError(f"origin must be one of {ORIGINS}")
    counts = interval_counts(log, interval_s, fill_gaps)
    names = ("new", "errors", *TOKENS)
    so_far = "OVER (PARTITION BY shard ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    first = "first_ok" if origin == "first_completion" else "first_start"
    rows = counts.selectExpr(
        "shard",
        "bucket",
        *[f"{name} AS interval_{name}" for name in names],
        *[f"sum({name}) {so_far} AS {name}" for name in names],
        f"min({first}) OVER (PARTITION BY shard) AS origin",
    )
    return report_rows(rows, totals, interval_s, origin, num_shards, existing, count_errors)


def report_rows(
    rows: DataFrame,
    totals: DataFrame,
    interval_s: int = 60,
    origin: str = "first_completion",
    num_shards: int | None = None,
    existing: DataFrame | None = None,
    count_errors: bool = True,
) -> DataFrame:
    """Reports from intervals with their running sums: shard, bucket, interval_*, the sums, and `origin` in microseconds."""
    known = totals.select("shard", "total")
    if existing is not None:
        known = known.join(existing.select("shard", "existing"), "shard", "left")
        known = known.selectExpr("shard", "total", "coalesce(existing, 0L) AS existing")
    else:
        known = known.selectExpr("shard", "total", "0L AS existing")
    rows = rows.join(known, "shard")
    if origin == "first_completion":
        rows = rows.where("new > 0")
    length = interval_s * MICROS
    report = f"(bucket + 1) * {length}L"
    begin = f"greatest(bucket * {length}L, origin)"
    rows = rows.selectExpr(
        "*",
        f"{report} / {MICROS} AS timestamp",
        f"({report} - origin) / {MICROS} AS elapsed_seconds",
        f"({report} - {begin}) / {MICROS} AS duration_seconds",
        f"new + existing + {'errors' if count_errors else '0L'} AS completed",
    )
    amounts = ("new", "total_tokens", "prompt_tokens", "completion_tokens")
    rows = rows.selectExpr(
        "*",
        *[f"{_rate(a, 'elapsed_seconds')} AS overall_{r}" for a, r in zip(amounts, RATE_NAMES)],
        *[f"{_rate(f'interval_{a}', 'duration_seconds')} AS interval_{r}" for a, r in zip(amounts, RATE_NAMES)],
    )
    rate = "interval_requests_per_second"
    rows = rows.drop("origin").selectExpr(
        "*",
        f"CASE WHEN {rate} > 0 THEN greatest(total - completed, 0L) / {rate} ELSE 0D END AS eta_seconds",
        f"CAST({num_shards if num_shards else 'NULL'} AS INT) AS num_shards",
    )
    return rows.withColumn("eta_formatted", format_duration("eta_seconds"))


def per_hour(rows: DataFrame) -> DataFrame:
    """Progress rows with each rate per hour as well."""
    names = [f"{part}_{name}" for part in ("overall", "interval") for name in RATE_NAMES]
    return rows.select("*", *[(F.col(n) * 3600).alias(n.replace("per_second", "per_hour")) for n in names])


def progress_records(rows: DataFrame) -> DataFrame:
    """Progress rows as nested records, the shape of the JSON log.

    In the log, failed rows are part of `existing`.
    """
    rows = per_hour(rows)

    def rates(part: str) -> list[Column]:
        names = [*RATE_NAMES, *[n.replace("per_second", "per_hour") for n in RATE_NAMES]]
        return [F.col(f"{part}_{name}").alias(name) for name in names]

    return rows.select(
        "timestamp",
        "shard",
        "num_shards",
        F.struct(
            "completed",
            "total",
            "new",
            (F.col("completed") - F.col("new")).alias("existing"),
            "eta_seconds",
            "eta_formatted",
        ).alias("progress"),
        F.struct(
            F.struct(*rates("overall")).alias("overall"),
            F.struct(
                "duration_seconds",
                F.col("interval_new").alias("new"),
                F.lit(0).cast("bigint").alias("existing"),
                *rates("interval"),
            ).alias("last_interval"),
        ).alias("throughput"),
    )


def status_rows(rows: DataFrame) -> DataFrame:
    """Progress rows in the columns of a flattened progress log."""
    return rows.select(
        "shard",
        "num_shards",
        "timestamp",
        F.timestamp_seconds("timestamp").alias("datetime"),
        "completed",
        "total",
        "new",
        (F.col("completed") - F.col("new")).alias("existing"),
        "eta_seconds",
        "eta_formatted",
        F.col("overall_requests_per_second").alias("overall_requests_ps"),
        F.col("overall_total_tokens_per_second").alias("overall_total_tps"),
        F.col("overall_prompt_tokens_per_second").alias("overall_prompt_tps"),
        F.col("overall_completion_tokens_per_second").alias("overall_completion_tps"),
    )
