"""Status of a run, from flattened progress rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.functions.formatting import (
    bar,
    count_text,
    one_decimal,
    or_missing,
    percent_text,
    rate_text,
    timestamp_text,
)
from inkwell.functions.sharding import check_shards

# Short name -> column of the progress rows.
RATES = {
    "requests_ps": "overall_requests_ps",
    "total_tps": "overall_total_tps",
    "prompt_tps": "overall_prompt_tps",
    "completion_tps": "overall_completion_tps",
}


def recent(progress: DataFrame, cutoff: float) -> DataFrame:
    """Rows at or after the cutoff, in epoch seconds."""
    return progress.where(F.col("timestamp") >= F.lit(float(cutoff)))


def only_shards(progress: DataFrame, shards: list[int], num_shards: int) -> DataFrame:
    """Rows of a shard subset; a number out of range is an error."""
    return progress.where(F.col("shard").isin(check_shards(shards, num_shards)))


def latest_per_shard(progress: DataFrame, *columns: str) -> DataFrame:
    """The last value of each column per shard, by time, with the time."""
    last = [F.max_by(name, "timestamp").alias(name) for name in columns]
    return progress.groupBy("shard").agg(F.max("timestamp").alias("latest_timestamp"), *last)


def current_throughput(progress: DataFrame, cutoff: float) -> DataFrame:
    """One row: shards heard of since the cutoff and the sum of their last rates."""
    last = latest_per_shard(recent(progress, cutoff), *RATES.values())
    sums = [F.coalesce(F.sum(column), F.lit(0.0)).alias(name) for name, column in RATES.items()]
    return last.agg(F.count(F.lit(1)).alias("active_shards"), *sums)


def _shard_list(df: DataFrame, shards: list[int] | None, num_shards: int | None) -> DataFrame:
    spark = df.sparkSession
    if shards is not None:
        return spark.createDataFrame([(s,) for s in sorted(set(shards))], "shard int")
    if num_shards is None:
        first = df.select(F.max("num_shards")).first()
        num_shards = (first[0] if first else None) or 0
    return spark.range(num_shards).select(F.col("id").cast("int").alias("shard"))


def shard_stats(
    progress: DataFrame, cutoff: float, shards: list[int] | None = None, num_shards: int | None = None
) -> DataFrame:
    """One row per shard, also for those without data: last state, mean rates, entries, status."""
    grouped = progress.groupBy("shard").agg(
        F.max("timestamp").alias("latest_timestamp"),
        *[
            F.max_by(name, "timestamp").alias(alias)
            for name, alias in (
                ("datetime", "latest_datetime"),
                ("completed", "completed"),
                ("total", "total"),
                ("eta_seconds", "eta_seconds"),
                ("eta_formatted", "eta_formatted"),
            )
        ],
        F.count(F.lit(1)).alias("entries"),
        *[F.avg(column).alias(f"avg_{name}") for name, column in RATES.items()],
    )
    joined = _shard_list(progress, shards, num_shards).join(grouped, "shard", "left")
    status = (
        F.when(F.col("latest_timestamp").isNull(), "No Data")
        .when(F.col("latest_timestamp") >= F.lit(float(cutoff)), "active")
        .otherwise("inactive")
    )
    return joined.withColumns(
        {
            "entries": F.coalesce("entries", F.lit(0)),
            "progress_pct": F.try_divide(F.col("completed"), F.col("total")) * 100,
            "status": status,
        }
    )


def shard_board(stats: DataFrame, completed: DataFrame) -> DataFrame:
    """`shard_stats` as display text, with the completed flag. `completed` has distinct shards."""
    flags = completed.select("shard", F.lit(True).alias("done"))

    def rate(name: str) -> Column:
        return F.coalesce(one_decimal(name), F.lit("-"))

    has_data = F.col("latest_timestamp").isNotNull()
    return stats.join(flags, "shard", "left").select(
        "shard",
        F.coalesce("done", F.lit(False)).alias("completed"),
        percent_text("progress_pct").alias("progress"),
        F.col("entries").cast("string").alias("entries"),
        "status",
        *[rate(f"avg_{name}").alias(name) for name in RATES],
        F.coalesce(timestamp_text("latest_datetime"), F.lit("-")).alias("last_update"),
        F.when(has_data, or_missing("eta_formatted")).otherwise("-").alias("eta"),
    )


def throughput_board(totals: DataFrame) -> DataFrame:
    """`current_throughput` as display text."""
    return totals.select("active_shards", *[rate_text(name).alias(name) for name in RATES])


def run_summary(
    progress: DataFrame,
    completed: DataFrame,
    cutoff: float,
    shards: list[int] | None = None,
    num_shards: int | None = None,
    strict_eta: bool = False,
) -> DataFrame:
    """One row about the whole run.

    `total_requests` sums the shards' own totals; a shard without data is taken
    at the mean of the others. The longest ETA is unknown (`∞`) while a shard
    that is not completed is not active; with `strict_eta`, completed shards are
    not excepted.
    """
    columns = ("completed", "total", "eta_seconds", "eta_formatted")
    per_shard = progress.groupBy("shard").agg(
        F.min("timestamp").alias("first_timestamp"),
        F.max("timestamp").alias("latest_timestamp"),
        *[F.max_by(name, "timestamp").alias(name) for name in columns],
    )
    flags = completed.select("shard").distinct().withColumn("done", F.lit(True))
    rows = (
        _shard_list(progress, shards, num_shards)
        .join(per_shard, "shard", "left")
        .join(flags, "shard", "left")
    )
    active = F.coalesce(F.col("latest_timestamp") >= F.lit(float(cutoff)), F.lit(False))
    settled = active if strict_eta else active | F.coalesce("done", F.lit(False))
    summed = rows.agg(
        F.count(F.lit(1)).alias("total_shards"),
        F.count("done").alias("shards_completed"),
        F.count("latest_timestamp").alias("shards_with_data"),
        F.count_if(active).alias("active_shards"),
        ((F.max("latest_timestamp") - F.min("first_timestamp")) / 60).alias("duration_minutes"),
        F.coalesce(F.sum("completed"), F.lit(0)).alias("total_completed"),
        F.sum("total").alias("_known"),
        F.count_if(~settled).alias("_unsettled"),
        F.max("eta_seconds").alias("_eta_seconds"),
        F.max_by("eta_formatted", "eta_seconds").alias("_eta"),
    )
    missing = F.col("total_shards") - F.col("shards_with_data")
    estimate = F.round(F.coalesce(F.try_divide("_known", "shards_with_data"), F.lit(0.0)) * missing)
    total = (F.coalesce("_known", F.lit(0)) + estimate.cast("bigint")).alias("total_requests")
    eta = (
        F.when(F.col("_unsettled") > 0, "∞")
        .when(F.col("_eta_seconds") > 0, or_missing("_eta"))
        .otherwise("N/A")
    )
    return summed.select("*", total, eta.alias("longest_eta")).select(
        "total_shards",
        "shards_completed",
        "shards_with_data",
        "active_shards",
        "duration_minutes",
        "total_completed",
        "total_requests",
        (F.coalesce(F.try_divide("total_completed", "total_requests"), F.lit(0.0)) * 100).alias("progress_pct"),
        "longest_eta",
    )


def summary_board(summary: DataFrame) -> DataFrame:
    """`run_summary` as display text: field, value."""
    lines = [
        ("Total shards", F.col("total_shards").cast("string")),
        ("Shards completed", F.col("shards_completed").cast("string")),
        ("Shards w/ data", F.col("shards_with_data").cast("string")),
        ("Active shards", F.col("active_shards").cast("string")),
        ("Duration", F.concat(one_decimal("duration_minutes"), F.lit(" minutes"))),
        ("Total completed", count_text("total_completed")),
        ("Total requests", count_text("total_requests")),
        ("Overall progress", percent_text("progress_pct")),
        ("Longest ETA", F.col("longest_eta")),
    ]
    entries = [F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in lines]
    return summary.select(F.inline(F.array(*entries)))


def throughput_stats(progress: DataFrame, *by: str) -> DataFrame:
    """Mean, least and greatest token rates."""
    names = ("total_tps", "prompt_tps", "completion_tps")
    return progress.groupBy(*by).agg(
        *[fn(RATES[n]).alias(f"{prefix}_{n}") for n in names for prefix, fn in (("avg", F.avg), ("min", F.min), ("max", F.max))]
    )


def throughput_bars(progress: DataFrame, width: int = 50) -> DataFrame:
    """Token rates over time as bars, per shard, all on the scale of the total rate."""
    shard = W.partitionBy("shard")
    largest = F.max(RATES["total_tps"]).over(shard)
    rows = progress.select("shard", "timestamp", *[RATES[n] for n in ("total_tps", "prompt_tps", "completion_tps")], largest.alias("largest"))
    series = F.array(
        *[
            F.struct(F.lit(n).alias("series"), F.col(RATES[n]).alias("value"))
            for n in ("total_tps", "prompt_tps", "completion_tps")
        ]
    )
    return rows.select("shard", "timestamp", "largest", F.inline(series)).select(
        "shard", "timestamp", "series", "value", bar("value", "largest", width).alias("bar")
    )


def run_duration(progress: DataFrame, *by: str) -> DataFrame:
    """Minutes between the first and the last report."""
    return progress.groupBy(*by).agg(((F.max("timestamp") - F.min("timestamp")) / 60).alias("duration_minutes"))
