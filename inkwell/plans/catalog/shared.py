"""Frames and SQL fragments that several queries use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.config import RunConfig
from inkwell.functions.errors import error_class
from inkwell.operators.client import StubClient
from inkwell.plans.catalog.registry import table
from inkwell.plans.run import run
from inkwell.session import scratch_path

TEMPLATE = (
    "Rate the educational value of this extract from 0 to 5.\n\n{document}\n\n"
    'Conclude with the format: "Educational score:  <total points>"'
)
SYSTEM = "You translate documents and answer with the translation only."
TRANSLATE = "Translate this document to German.\n\n<document>\n{document}\n</document>"
PREFILL = "<translated_document>"

# SQL text of the filled template, for documents.text.
SQL_PROMPT = (
    "E'Rate the educational value of this extract from 0 to 5.\\n\\n' || text || "
    "E'\\n\\nConclude with the format: \"Educational score:  <total points>\"'"
)
SQL_TRANSLATE = (
    "E'Translate this document to German.\\n\\n<document>\\n' || text || E'\\n</document>'"
)

# SQL text of the shard of an id.
SQL_SHARD = "CAST(CAST('0x' || substr(md5({id}), 1, 8) AS BIGINT) % {n} AS INTEGER)"

NUM_SHARDS = 4
OK_EVENTS = ("click", "purchase", "view")

# Results the stub gives for every document, in SQL.
SQL_ANSWERS = f"""
prompts AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, lang, length({SQL_PROMPT}) AS n FROM documents),
answers AS (
  SELECT id, doc_id, lang, n,
    E'<think>ok</think>\\n\\nEducational score: ' || CAST(n % 6 AS VARCHAR) AS content,
    CAST(n // 4 AS INTEGER) AS prompt_tokens, CAST(8 AS INTEGER) AS completion_tokens,
    CAST(n // 4 + 8 AS INTEGER) AS total_tokens,
    {SQL_SHARD.format(id="id", n=NUM_SHARDS)} AS shard
  FROM prompts)
"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a string id."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), "doc_id", "text", "lang", "source"
    )


def document_config(output_path: str, **changes) -> RunConfig:
    values = dict(
        api_type="chat-completion",
        model="stub-model",
        dataset_path="documents",
        output_path=output_path,
        input_column_name="messages",
        apply_udf="template_messages",
        apply_udf_kwargs={"template": TEMPLATE},
        max_connections=16,
        num_workers=2,
        num_inference_servers=NUM_SHARDS,
    )
    return RunConfig(**{**values, **changes})


_runs: dict[tuple[str, str], str] = {}


def document_results(spark: SparkSession, sf_dir: str) -> str:
    """Path of the results table of all documents; made once per session and data set."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _runs:
        path = scratch_path(spark, "results")
        run(spark, document_config(path), StubClient(), documents(spark, sf_dir), run_id="catalog")
        _runs[key] = path
    return _runs[key]


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request log from `events`: one row per event."""
    events = table(spark, sf_dir, "events")
    ok = F.col("event_type").isin(*OK_EVENTS)
    failed = F.col("event_type") == "error"
    third = F.col("user_id") % 3
    text = (
        F.when(failed & (third == 0), "Connection refused by host")
        .when(failed & (third == 1), "Request timed out")
        .when(failed, "bad request: unknown field")
        .when(F.col("event_type") == "signup", "This model has a maximum Context Length of 16384")
    )
    prompt = F.when(ok, F.floor(F.col("value") * 10).cast("int"))
    completion = F.when(ok, F.floor("value").cast("int"))
    return events.select(
        F.col("event_id").cast("string").alias("id"),
        (F.col("user_id") % 4).cast("int").alias("shard"),
        F.col("ts").cast("timestamp").alias("finished_at"),
        F.when(ok, "ok").otherwise("error").alias("status"),
        text.alias("error_text"),
        error_class(text).alias("error_class"),
        prompt.alias("prompt_tokens"),
        completion.alias("completion_tokens"),
        (prompt + completion).alias("total_tokens"),
    )


SQL_LOG = """
raw AS (
  SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id % 4 AS INTEGER) AS shard, ts AS finished_at,
    CASE WHEN event_type IN ('click', 'purchase', 'view') THEN 'ok' ELSE 'error' END AS status,
    CASE WHEN event_type = 'error' AND user_id % 3 = 0 THEN 'Connection refused by host'
         WHEN event_type = 'error' AND user_id % 3 = 1 THEN 'Request timed out'
         WHEN event_type = 'error' THEN 'bad request: unknown field'
         WHEN event_type = 'signup' THEN 'This model has a maximum Context Length of 16384' END AS error_text,
    CASE WHEN event_type IN ('click', 'purchase', 'view') THEN CAST(floor(value * 10) AS INTEGER) END AS prompt_tokens,
    CASE WHEN event_type IN ('click', 'purchase', 'view') THEN CAST(floor(value) AS INTEGER) END AS completion_tokens
  FROM events),
log AS (
  SELECT *, prompt_tokens + completion_tokens AS total_tokens,
    CASE WHEN error_text IS NULL THEN NULL
         WHEN lower(error_text) LIKE '%context length%' OR lower(error_text) LIKE '%context\\_length%' ESCAPE '\\'
           OR lower(error_text) LIKE '%too many tokens%' THEN 'context_length'
         WHEN regexp_matches(lower(error_text),
           'connection|timeout|timed out|network|unreachable|refused|reset|unavailable') THEN 'api'
         ELSE 'other' END AS error_class
  FROM raw)
"""

INTERVAL_S = 21_600

SQL_PROGRESS = (
    SQL_LOG
    + f""",
counts AS (
  SELECT shard, epoch_us(finished_at) // {INTERVAL_S * 1_000_000} AS bucket,
    count(*) FILTER (status = 'ok') AS new, count(*) FILTER (status = 'error') AS errors,
    coalesce(sum(prompt_tokens), 0) AS pt, coalesce(sum(completion_tokens), 0) AS ct,
    coalesce(sum(total_tokens), 0) AS tt,
    min(epoch_us(finished_at)) FILTER (status = 'ok') AS first_ok, min(epoch_us(finished_at)) AS first_start
  FROM log GROUP BY 1, 2),
every AS (SELECT shard, unnest(generate_series(min(bucket), max(bucket))) AS bucket FROM counts GROUP BY shard),
filled AS (
  SELECT e.shard, e.bucket, coalesce(new, 0) AS inew, coalesce(errors, 0) AS ierr, coalesce(pt, 0) AS ipt,
    coalesce(ct, 0) AS ict, coalesce(tt, 0) AS itt, first_ok, first_start
  FROM every e LEFT JOIN counts c ON e.shard = c.shard AND e.bucket = c.bucket),
totals AS (SELECT shard, count(*) AS total FROM log GROUP BY shard),
summed AS (
  SELECT f.shard, bucket, inew, ierr, CAST(ipt AS BIGINT) AS ipt, CAST(ict AS BIGINT) AS ict, CAST(itt AS BIGINT) AS itt,
    CAST(sum(inew) OVER w AS BIGINT) AS new, CAST(sum(ierr) OVER w AS BIGINT) AS errors,
    CAST(sum(ipt) OVER w AS BIGINT) AS pt, CAST(sum(ict) OVER w AS BIGINT) AS ct, CAST(sum(itt) OVER w AS BIGINT) AS tt,
    min({{first}}) OVER (PARTITION BY f.shard) AS origin, total
  FROM filled f JOIN totals t ON f.shard = t.shard
  WINDOW w AS (PARTITION BY f.shard ORDER BY bucket)),
timed AS (
  SELECT *, (bucket + 1) * {INTERVAL_S * 1_000_000} / 1000000 AS timestamp,
    ((bucket + 1) * {INTERVAL_S * 1_000_000} - origin) / 1000000 AS elapsed,
    ((bucket + 1) * {INTERVAL_S * 1_000_000} - greatest(bucket * {INTERVAL_S * 1_000_000}, origin)) / 1000000 AS duration,
    new + errors AS completed
  FROM summed {{where}}),
prog AS (
  SELECT *,
    CASE WHEN elapsed > 0 THEN CAST(new AS DOUBLE) / elapsed ELSE 0 END AS rps,
    CASE WHEN elapsed > 0 THEN CAST(tt AS DOUBLE) / elapsed ELSE 0 END AS total_tps,
    CASE WHEN elapsed > 0 THEN CAST(pt AS DOUBLE) / elapsed ELSE 0 END AS prompt_tps,
    CASE WHEN elapsed > 0 THEN CAST(ct AS DOUBLE) / elapsed ELSE 0 END AS completion_tps,
    CASE WHEN duration > 0 THEN CAST(inew AS DOUBLE) / duration ELSE 0 END AS irps,
    CASE WHEN duration > 0 THEN CAST(itt AS DOUBLE) / duration ELSE 0 END AS itps,
    CASE WHEN inew > 0 AND duration > 0 THEN CAST(total - completed AS DOUBLE) / (CAST(inew AS DOUBLE) / duration) ELSE 0 END AS eta
  FROM timed)
"""
)


def sql_progress(origin: str = "first_completion") -> str:
    if origin == "first_completion":
        return SQL_PROGRESS.format(first="first_ok", where="WHERE new > 0")
    return SQL_PROGRESS.format(first="first_start", where="")
