"""Progress, throughput, breaker and shard status over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions.formatting import count_text, epoch_timestamp, format_duration, percent_text, rate_text, timestamp_text
from inkwell.operators.breaker import breaker_trips, longest_streaks
from inkwell.operators.ledger import job_state_counts, shard_ledger, shards_to_submit, status_board
from inkwell.operators.outcomes import shard_completion, shard_totals
from inkwell.operators.progress import per_hour, progress, progress_records, report_rows, status_rows
from inkwell.operators.status import (
    current_throughput,
    latest_per_shard,
    only_shards,
    recent,
    run_duration,
    run_summary,
    shard_board,
    shard_stats,
    throughput_bars,
    throughput_stats,
)
from inkwell.plans.catalog.registry import query, table
from inkwell.plans.catalog.shared import INTERVAL_S, SQL_LOG, event_log, sql_progress
from inkwell.session import scratch_path
from inkwell.sinks.tables import append_progress
from inkwell.sources.ledgers import normalise_jobs
from inkwell.sources.progress_log import read_progress
from inkwell.streaming.state import INTERVALS, TRIPS, first_trips, running_intervals, write_stream
from inkwell.streaming.throughput import read_throughput, windowed_counts, write_throughput

CUTOFF = 1_706_637_600.0  # 2024-01-30 18:00:00 UTC
BOARD_SHARDS = 64


def event_progress(spark, sf_dir, origin="first_completion", num_shards=6):
    """Six-hour progress of the event log; two of the shards have no data."""
    log = event_log(spark, sf_dir)
    totals = log.groupBy("shard").agg(F.count(F.lit(1)).alias("total"))
    return progress(log, totals, INTERVAL_S, origin, num_shards)


def status_progress(spark, sf_dir):
    return status_rows(event_progress(spark, sf_dir))


_PROGRESS_COLUMNS = """shard, timestamp, new, errors, completed, total, elapsed AS elapsed_seconds, duration AS duration_seconds,
  inew AS interval_new, rps AS overall_requests_per_second, total_tps AS overall_total_tokens_per_second,
  prompt_tps AS overall_prompt_tokens_per_second, completion_tps AS overall_completion_tokens_per_second,
  irps AS interval_requests_per_second, itps AS interval_total_tokens_per_second"""


def _progress_columns(rows):
    return rows.select(
        "shard", "timestamp", "new", "errors", "completed", "total", "elapsed_seconds", "duration_seconds", "interval_new",
        "overall_requests_per_second", "overall_total_tokens_per_second", "overall_prompt_tokens_per_second",
        "overall_completion_tokens_per_second", "interval_requests_per_second", "interval_total_tokens_per_second",
    )


@query("progress_log", f"WITH {sql_progress()} SELECT {_PROGRESS_COLUMNS} FROM prog")
def progress_log(spark, sf_dir):
    """Counts and rates per shard and report interval, from the first completion."""
    return _progress_columns(event_progress(spark, sf_dir))


@query("progress_from_start", f"WITH {sql_progress('start')} SELECT {_PROGRESS_COLUMNS} FROM prog")
def progress_from_start(spark, sf_dir):
    """The same with rates from the start of the run."""
    return _progress_columns(event_progress(spark, sf_dir, "start"))


@query("eta", f"WITH {sql_progress()} SELECT shard, timestamp, total - completed AS remaining, eta AS eta_seconds FROM prog")
def eta(spark, sf_dir):
    return event_progress(spark, sf_dir).select(
        "shard", "timestamp", (F.col("total") - F.col("completed")).alias("remaining"), "eta_seconds"
    )


@query(
    "rates_per_hour",
    f"""
WITH {sql_progress()}
SELECT shard, timestamp, rps * 3600 AS overall_requests_per_hour, total_tps * 3600 AS overall_total_tokens_per_hour,
  irps * 3600 AS interval_requests_per_hour FROM prog
""",
)
def rates_per_hour(spark, sf_dir):
    return per_hour(event_progress(spark, sf_dir)).select(
        "shard", "timestamp", "overall_requests_per_hour", "overall_total_tokens_per_hour", "interval_requests_per_hour"
    )


@query(
    "progress_records",
    f"""
WITH {sql_progress()}
SELECT shard, CAST(6 AS INTEGER) AS num_shards, timestamp, completed, total, new, errors AS existing, eta AS eta_seconds,
  rps AS overall_requests_ps, total_tps AS overall_total_tps FROM prog
""",
)
def progress_round_trip(spark, sf_dir):
    """Nested JSON records, written and read back flat."""
    path = scratch_path(spark, "progress")
    append_progress(progress_records(event_progress(spark, sf_dir)), path)
    return read_progress(spark, path).select(
        "shard", "num_shards", "timestamp", "completed", "total", "new", "existing", "eta_seconds",
        "overall_requests_ps", "overall_total_tps",
    )


_SQL_LAST = """
last AS (
  SELECT shard, max(timestamp) AS latest_timestamp, arg_max(completed, timestamp) AS completed,
    arg_max(total, timestamp) AS total, arg_max(eta, timestamp) AS eta_seconds, count(*) AS entries,
    avg(rps) AS avg_requests_ps, avg(total_tps) AS avg_total_tps, min(timestamp) AS first_timestamp FROM prog GROUP BY shard),
shards AS (SELECT CAST(unnest(range(6)) AS INTEGER) AS shard)
"""


# The text of the longest ETA.
_SQL_LONGEST = """CASE WHEN coalesce(max(eta_seconds), 0) <= 0 THEN 'N/A'
    WHEN max(eta_seconds) < 60 THEN printf('%.1f', max(eta_seconds)) || 's'
    WHEN max(eta_seconds) < 3600 THEN printf('%.1f', max(eta_seconds) / 60) || 'm'
    ELSE printf('%.1f', max(eta_seconds) / 3600) || 'h' END"""


@query(
    "latest_per_shard",
    f"WITH {sql_progress()}, {_SQL_LAST} SELECT shard, latest_timestamp, completed, total, eta_seconds FROM last",
)
def latest(spark, sf_dir):
    return latest_per_shard(status_progress(spark, sf_dir), "completed", "total", "eta_seconds")


@query(
    "shard_stats",
    f"""
WITH {sql_progress()}, {_SQL_LAST}
SELECT s.shard, latest_timestamp, completed, total, eta_seconds, coalesce(entries, 0) AS entries,
  round(avg_requests_ps, 9) AS avg_requests_ps, round(avg_total_tps, 6) AS avg_total_tps,
  CAST(completed AS DOUBLE) / total * 100 AS progress_pct,
  CASE WHEN latest_timestamp IS NULL THEN 'No Data' WHEN latest_timestamp >= {CUTOFF} THEN 'active' ELSE 'inactive' END AS status
FROM shards s LEFT JOIN last l ON l.shard = s.shard
""",
)
def stats(spark, sf_dir):
    """Every shard of the run, also those without data."""
    return shard_stats(status_progress(spark, sf_dir), CUTOFF, num_shards=6).select(
        "shard", "latest_timestamp", "completed", "total", "eta_seconds", "entries",
        F.round("avg_requests_ps", 9).alias("avg_requests_ps"), F.round("avg_total_tps", 6).alias("avg_total_tps"),
        "progress_pct", "status",
    )


@query(
    "shard_board",
    f"""
WITH {sql_progress()}, {_SQL_LAST}
SELECT s.shard, s.shard IN (0, 5) AS completed,
  coalesce(printf('%.1f', CAST(completed AS DOUBLE) / total * 100) || '%', '-') AS progress,
  CAST(coalesce(entries, 0) AS VARCHAR) AS entries,
  coalesce(strftime(make_timestamp(CAST(latest_timestamp * 1000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S'), '-') AS last_update,
  CASE WHEN latest_timestamp IS NULL THEN '-' WHEN eta_seconds < 60 THEN printf('%.1f', eta_seconds) || 's'
    WHEN eta_seconds < 3600 THEN printf('%.1f', eta_seconds / 60) || 'm' ELSE printf('%.1f', eta_seconds / 3600) || 'h' END AS eta
FROM shards s LEFT JOIN last l ON l.shard = s.shard
""",
)
def board(spark, sf_dir):
    """The per-shard table as text."""
    completed = spark.createDataFrame([(0,), (5,)], "shard int")
    rows = shard_board(shard_stats(status_progress(spark, sf_dir), CUTOFF, num_shards=6), completed)
    return rows.select("shard", "completed", "progress", "entries", "last_update", "eta")


@query(
    "current_throughput",
    f"""
WITH {sql_progress()}, newest AS (
  SELECT shard, arg_max(rps, timestamp) AS rps, arg_max(total_tps, timestamp) AS total_tps,
    arg_max(prompt_tps, timestamp) AS prompt_tps, arg_max(completion_tps, timestamp) AS completion_tps
  FROM prog WHERE timestamp >= {CUTOFF} GROUP BY shard)
SELECT count(*) AS active_shards, round(coalesce(sum(rps), 0), 9) AS requests_ps, round(coalesce(sum(total_tps), 0), 6) AS total_tps,
  round(coalesce(sum(prompt_tps), 0), 6) AS prompt_tps, round(coalesce(sum(completion_tps), 0), 6) AS completion_tps FROM newest
""",
)
def throughput_now(spark, sf_dir):
    rows = current_throughput(status_progress(spark, sf_dir), CUTOFF)
    return rows.select(
        "active_shards", F.round("requests_ps", 9).alias("requests_ps"), F.round("total_tps", 6).alias("total_tps"),
        F.round("prompt_tps", 6).alias("prompt_tps"), F.round("completion_tps", 6).alias("completion_tps"),
    )


@query(
    "run_summary",
    f"""
WITH {sql_progress()}, {_SQL_LAST}
SELECT count(*) AS total_shards, CAST(2 AS BIGINT) AS shards_completed, count(latest_timestamp) AS shards_with_data,
  count(*) FILTER (latest_timestamp >= {CUTOFF}) AS active_shards,
  (max(latest_timestamp) - min(first_timestamp)) / 60 AS duration_minutes, CAST(sum(completed) AS BIGINT) AS total_completed,
  CAST(sum(total) + round(CAST(sum(total) AS DOUBLE) / count(total) * (count(*) - count(total))) AS BIGINT) AS total_requests,
  CASE WHEN count(*) FILTER (s.shard NOT IN (4, 5) AND (latest_timestamp IS NULL OR latest_timestamp < {CUTOFF})) > 0
    THEN '∞' ELSE {_SQL_LONGEST} END AS longest_eta,
  CASE WHEN count(*) FILTER (s.shard NOT IN (4, 5) AND latest_timestamp IS NULL) > 0 THEN '∞' ELSE {_SQL_LONGEST} END
    AS longest_eta_if_all_report
FROM shards s LEFT JOIN last l ON l.shard = s.shard
""",
)
def summary(spark, sf_dir):
    completed = spark.createDataFrame([(4,), (5,)], "shard int")
    rows = run_summary(status_progress(spark, sf_dir), completed, CUTOFF, num_shards=6)
    report = run_summary(status_progress(spark, sf_dir), completed, 0.0, num_shards=6)
    return rows.select(
        "total_shards", "shards_completed", "shards_with_data", "active_shards", "duration_minutes", "total_completed",
        "total_requests", "longest_eta",
    ).join(report.select("total_shards", F.col("longest_eta").alias("longest_eta_if_all_report")), "total_shards")


@query("recent_activity", f"WITH {sql_progress()} SELECT shard, timestamp, completed FROM prog WHERE timestamp >= {CUTOFF}")
def recent_activity(spark, sf_dir):
    return recent(status_progress(spark, sf_dir), CUTOFF).select("shard", "timestamp", "completed")


@query("monitored_shards", f"WITH {sql_progress()} SELECT shard, timestamp, completed FROM prog WHERE shard IN (1, 3)")
def monitored_shards(spark, sf_dir):
    return only_shards(status_progress(spark, sf_dir), [3, 1], 6).select("shard", "timestamp", "completed")


@query(
    "throughput_min_max",
    f"""
WITH {sql_progress()}
SELECT shard, round(avg(total_tps), 6) AS avg_total_tps, min(total_tps) AS min_total_tps, max(total_tps) AS max_total_tps,
  min(prompt_tps) AS min_prompt_tps, max(completion_tps) AS max_completion_tps FROM prog GROUP BY shard
""",
)
def throughput_min_max(spark, sf_dir):
    return throughput_stats(status_progress(spark, sf_dir), "shard").select(
        "shard", F.round("avg_total_tps", 6).alias("avg_total_tps"), "min_total_tps", "max_total_tps", "min_prompt_tps",
        "max_completion_tps",
    )


@query(
    "throughput_bars",
    f"""
WITH {sql_progress()}, series AS (
  SELECT shard, timestamp, 'total_tps' AS series, total_tps AS value FROM prog
  UNION ALL SELECT shard, timestamp, 'prompt_tps', prompt_tps FROM prog
  UNION ALL SELECT shard, timestamp, 'completion_tps', completion_tps FROM prog),
top AS (SELECT shard, max(total_tps) AS largest FROM prog GROUP BY shard)
SELECT s.shard, timestamp, series, value, repeat('█', CAST(floor(value / largest * 50) AS INTEGER)) AS bar
FROM series s JOIN top t ON t.shard = s.shard
""",
)
def bars(spark, sf_dir):
    return throughput_bars(status_progress(spark, sf_dir))


@query(
    "run_duration",
    f"WITH {sql_progress()} SELECT shard, (max(timestamp) - min(timestamp)) / 60 AS duration_minutes FROM prog GROUP BY shard",
)
def duration(spark, sf_dir):
    return run_duration(status_progress(spark, sf_dir), "shard")


_SQL_STREAKS = f"""
{SQL_LOG}, kinds AS (
  SELECT shard, id, finished_at, status = 'ok' AS good, coalesce(error_class = 'api', FALSE) AS bad FROM log),
islands AS (
  SELECT *, count(*) FILTER (good) OVER (PARTITION BY shard ORDER BY finished_at, id) AS island FROM kinds),
streaks AS (
  SELECT *, count(*) FILTER (bad) OVER (PARTITION BY shard, island ORDER BY finished_at, id) AS streak FROM islands WHERE bad)
"""


@query(
    "breaker_first_trip",
    f"""
WITH {_SQL_STREAKS}
SELECT shard, epoch_us(min(finished_at)) AS tripped_at, arg_min(id, finished_at) AS id FROM streaks WHERE streak >= 3 GROUP BY shard
""",
)
def breaker_first_trip(spark, sf_dir):
    """Where three failures in a row first came together, per shard."""
    return breaker_trips(event_log(spark, sf_dir), 3).select("shard", F.unix_micros("tripped_at").alias("tripped_at"), "id")


@query("longest_streaks", f"WITH {_SQL_STREAKS} SELECT shard, CAST(max(streak) AS BIGINT) AS longest_streak FROM streaks GROUP BY shard")
def streaks(spark, sf_dir):
    return longest_streaks(event_log(spark, sf_dir))


@query(
    "format_duration",
    """
SELECT event_id, CASE WHEN value < 60 THEN printf('%.1f', value) || 's' WHEN value < 3600 THEN printf('%.1f', value / 60) || 'm'
  ELSE printf('%.1f', value / 3600) || 'h' END AS short,
  CASE WHEN value * 977 < 60 THEN printf('%.1f', value * 977) || 's' WHEN value * 977 < 3600 THEN printf('%.1f', value * 977 / 60) || 'm'
  ELSE printf('%.1f', value * 977 / 3600) || 'h' END AS long
FROM events
""",
)
def durations(spark, sf_dir):
    """Durations as text, for every event value."""
    return table(spark, sf_dir, "events").select(
        "event_id", format_duration("value").alias("short"), format_duration(F.col("value") * 977).alias("long")
    )


@query(
    "number_text",
    """
SELECT o_orderkey, format('{:,.1f}', o_totalprice) AS price, printf('%.1f', o_totalprice / 1000) || '%' AS percent,
  format('{:,}', o_custkey * 1000) AS customer
FROM orders
""",
)
def number_text(spark, sf_dir):
    """Rates, percentages and counts as text."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        rate_text("o_totalprice").alias("price"),
        percent_text(F.col("o_totalprice") / 1000).alias("percent"),
        count_text(F.col("o_custkey") * 1000).alias("customer"),
    )


@query(
    "epoch_text",
    "SELECT event_id, strftime(make_timestamp(epoch_us(ts)), '%Y-%m-%d %H:%M:%S') AS text FROM events",
)
def epoch_text(spark, sf_dir):
    """Fractional epoch seconds to timestamps and to text."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    return table(spark, sf_dir, "events").select("event_id", timestamp_text(epoch_timestamp(seconds)).alias("text"))


_SQL_JOBS = f"""
jobs AS (
  SELECT 'anno-' || lpad(CAST(user_id % {BOARD_SHARDS} AS VARCHAR), 6, '0') AS name, event_id AS job_id,
    CAST(user_id % {BOARD_SHARDS} AS INTEGER) AS shard,
    CASE event_type WHEN 'click' THEN 'RUNNING' WHEN 'view' THEN 'COMPLETED' WHEN 'purchase' THEN 'PENDING'
      WHEN 'error' THEN 'FAILED' ELSE 'COMPLETING' END AS state
  FROM events WHERE user_id % 3 <> 0 OR event_type IN ('view', 'error')),
active AS (SELECT * FROM jobs WHERE state IN ('PENDING', 'RUNNING', 'CONFIGURING', 'COMPLETING')),
done AS (SELECT DISTINCT CAST(user_id % {BOARD_SHARDS} AS INTEGER) AS shard FROM events WHERE user_id % 5 = 0),
shards AS (SELECT CAST(unnest(range({BOARD_SHARDS})) AS INTEGER) AS shard)
"""


def event_jobs(spark, sf_dir, active_only=True):
    """A job per event, named after a shard; some states come as JSON arrays."""
    events = table(spark, sf_dir, "events").where("user_id % 3 <> 0 OR event_type IN ('view', 'error')")
    kind = F.col("event_type")
    state = (
        F.when(kind == "click", '["RUNNING"]')
        .when(kind == "view", '["COMPLETED"]')
        .when(kind == "purchase", "PENDING")
        .when(kind == "error", "FAILED")
        .otherwise('["COMPLETING","REQUEUED"]')
    )
    number = F.lpad((F.col("user_id") % BOARD_SHARDS).cast("string"), 6, "0")
    raw = events.select(
        F.concat(F.lit("anno-"), number).alias("name"), F.col("event_id").alias("job_id"), state.alias("job_state")
    )
    return normalise_jobs(raw, "anno", active_only)


def event_completed(spark, sf_dir):
    shard = (F.col("user_id") % BOARD_SHARDS).cast("int").alias("shard")
    return table(spark, sf_dir, "events").where("user_id % 5 = 0").select(shard).distinct()


@query(
    "shards_to_submit",
    f"WITH {_SQL_JOBS} SELECT shard FROM shards WHERE shard NOT IN (SELECT shard FROM active) AND shard NOT IN (SELECT shard FROM done)",
)
def to_submit(spark, sf_dir):
    """Shards neither completed nor in the queue; jobs of one user in ten are in it."""
    return shards_to_submit(BOARD_SHARDS, event_completed(spark, sf_dir), event_jobs(spark, sf_dir))


@query(
    "status_board",
    f"""
WITH {_SQL_JOBS}, last AS (
  SELECT shard, max(job_id) AS job_id, arg_max(CASE state WHEN 'COMPLETING' THEN 'COMPLETING,REQUEUED' ELSE state END, job_id) AS state
  FROM active GROUP BY shard)
SELECT s.shard, s.shard IN (SELECT shard FROM done) AS completed, coalesce(state, '-') AS state,
  coalesce(CAST(job_id AS VARCHAR), '-') AS job_id
FROM shards s LEFT JOIN last l ON l.shard = s.shard
""",
)
def status(spark, sf_dir):
    return status_board(BOARD_SHARDS, event_completed(spark, sf_dir), event_jobs(spark, sf_dir))


@query("job_states", f"WITH {_SQL_JOBS} SELECT state, count(*) AS num_jobs FROM jobs GROUP BY state")
def states(spark, sf_dir):
    return job_state_counts(event_jobs(spark, sf_dir, active_only=False))


@query("active_jobs", f"WITH {_SQL_JOBS} SELECT job_id, shard FROM active")
def active_jobs(spark, sf_dir):
    return event_jobs(spark, sf_dir).select("job_id", "shard")


@query(
    "shard_ledger",
    f"""
WITH {SQL_LOG}, ids AS (
  SELECT CAST(user_id % {BOARD_SHARDS} AS INTEGER) AS shard, event_id, event_type FROM events),
counts AS (
  SELECT shard, count(*) AS total, count(*) FILTER (event_type IN ('click', 'purchase', 'view')) AS succeeded,
    count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'signup') AS aborted FROM ids GROUP BY shard)
SELECT shard, CASE WHEN shard % 10 = 3 THEN 'validation_failed' WHEN succeeded + failed >= total THEN 'complete'
  WHEN aborted > 0 THEN 'breaker_tripped' ELSE 'incomplete' END AS state, total, succeeded, failed
FROM counts
""",
)
def ledger(spark, sf_dir):
    """State of every shard, with sign-ups as rows that were not sent."""
    shard = (F.col("user_id") % BOARD_SHARDS).cast("int").alias("shard")
    kind = F.col("event_type")
    status = F.when(kind == "signup", "aborted").when(kind == "error", "error").otherwise("ok")
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), shard, status.alias("status"))
    invalid = log.where("shard % 10 = 3").select("shard")
    return shard_ledger(shard_completion(shard_totals(log), log), invalid)


@query(
    "stream_throughput",
    f"""
WITH {SQL_LOG}
SELECT shard, epoch_us(finished_at) // 21600000000 * 21600000000 AS window_start, count(*) FILTER (status = 'ok') AS new,
  count(*) FILTER (status = 'error') AS errors, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total_tokens
FROM log GROUP BY 1, 2
""",
)
def stream_throughput(spark, sf_dir):
    """Throughput windows of a streamed log, last version of each."""
    folder, out = scratch_path(spark, "log-arrivals"), scratch_path(spark, "throughput")
    log = event_log(spark, sf_dir)
    log.write.parquet(folder)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 100).parquet(folder)
    counts = windowed_counts(stream, "6 hours", "40 days")
    write_throughput(counts, out, scratch_path(spark, "throughput-state")).awaitTermination()
    return read_throughput(spark, out).select(
        "shard", F.unix_micros("window_start").alias("window_start"), "new", "errors", "total_tokens"
    )


def _late_arrivals(spark, log):
    """A log as arriving files in four steps of time, a seventh of the rows a step late; (stream, lateness).

    A row far in the future comes last and moves the watermark past all others; it is left out behind it.
    """
    folder = scratch_path(spark, "late-arrivals")
    span = log.agg(F.min("finished_at").alias("lo"), F.max("finished_at").alias("hi")).first()
    step = max(1.0, (span.hi - span.lo).total_seconds() / 4)
    since = F.unix_micros("finished_at") - F.unix_micros(F.lit(span.lo))
    late = F.when(F.col("id").cast("bigint") % 7 == 0, 1).otherwise(0)
    placed = log.withColumn("step", (F.floor(since / (step * 1_000_000)) + late).cast("int"))
    for number in range(6):
        placed.where(F.col("step") == number).drop("step").write.mode("append").parquet(folder)
    last = F.lit(span.hi) + F.expr("INTERVAL 3650 DAYS")
    nothing = [F.lit(None).cast(t).alias(n) for n, t in log.dtypes if n not in ("finished_at", "shard")]
    marker = spark.range(1).select(last.alias("finished_at"), F.lit(-1).alias("shard"), *nothing).select(*log.columns)
    marker.write.mode("append").parquet(folder)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 8).parquet(folder)
    return stream, f"{int(step * 2) + 1} seconds"


@query("stream_progress", f"WITH {sql_progress()} SELECT {_PROGRESS_COLUMNS} FROM prog")
def stream_progress(spark, sf_dir):
    """Progress from the state of a stream whose rows come late: the same as from the whole log."""
    out, log = scratch_path(spark, "stream-progress"), event_log(spark, sf_dir)
    stream, lateness = _late_arrivals(spark, log)
    intervals = running_intervals(stream, INTERVAL_S, lateness).where("shard >= 0")
    write_stream(intervals, out, scratch_path(spark, "progress-state")).awaitTermination()
    rows = spark.read.schema(INTERVALS).parquet(out).withColumn("origin", F.col("first_ok"))
    totals = log.groupBy("shard").agg(F.count(F.lit(1)).alias("total"))
    return _progress_columns(report_rows(rows, totals, INTERVAL_S, num_shards=6))


@query(
    "stream_breaker",
    f"""
WITH {_SQL_STREAKS}
SELECT shard, epoch_us(min(finished_at)) AS tripped_at, arg_min(id, finished_at) AS id FROM streaks WHERE streak >= 3 GROUP BY shard
""",
)
def stream_breaker(spark, sf_dir):
    """Where three failures in a row first came together, from the state of a stream whose rows come late."""
    out = scratch_path(spark, "stream-breaker")
    stream, lateness = _late_arrivals(spark, event_log(spark, sf_dir))
    write_stream(first_trips(stream, 3, INTERVAL_S, lateness), out, scratch_path(spark, "breaker-state")).awaitTermination()
    return spark.read.schema(TRIPS).parquet(out).select("shard", F.unix_micros("tripped_at").alias("tripped_at"), "id")
