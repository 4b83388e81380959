"""Requests, responses and result tables over the given tables."""

from __future__ import annotations

import time

from pyspark.errors import PySparkException, StreamingQueryException
from pyspark.sql import functions as F

from inkwell.functions.errors import error_class
from inkwell.functions.parsing import (
    choices,
    content,
    finish_reason,
    first_choice,
    has_tag,
    parse_score,
    strip_think,
    text,
    until_tag,
    usage_columns,
)
from inkwell.functions.prompts import fill
from inkwell.operators.client import StubClient
from inkwell.operators.infer import align, infer
from inkwell.operators.ledger import all_shards
from inkwell.operators.outcomes import (
    id_counts,
    outcome_counts,
    request_log,
    shard_completion,
    shard_totals,
    usage_totals,
)
from inkwell.operators.resume import pending
from inkwell.operators.responses import join_back, latest_per_id, read_plain_responses, read_responses
from inkwell.operators.transforms import apply_named
from inkwell.plans.catalog.registry import query, table
from inkwell.plans.catalog.shared import (
    NUM_SHARDS,
    SQL_ANSWERS,
    SQL_LOG,
    TEMPLATE,
    document_config,
    document_results,
    documents,
    event_log,
)
from inkwell.plans.run import next_shards, run
from inkwell.schemas import COMPLETION_RESPONSE, one_line
from inkwell.session import materialize, scratch_path
from inkwell.sinks.compaction import compact
from inkwell.sinks.id_index import IdIndex
from inkwell.sinks.tables import adopt_responses, append_results, export_responses, file_inventory
from inkwell.sinks.task_files import files_in_progress
from inkwell.sources.ledgers import read_ledger
from inkwell.sources.progress_log import read_progress
from inkwell.sources.responses import done_ids, read_results
from inkwell.sources.shared_files import direct
from inkwell.streaming.annotate import annotate_stream, read_arrivals

_ANSWER_COLUMNS = "id, 'ok' AS status, 'stop' AS finish_reason, content, prompt_tokens, completion_tokens, total_tokens"


@query("infer_chat", f"WITH {SQL_ANSWERS} SELECT {_ANSWER_COLUMNS} FROM answers")
def infer_chat(spark, sf_dir):
    """The request map on whole documents, chat form."""
    config = document_config("unused")
    rows = align(documents(spark, sf_dir).select("id", "text"), config)
    todo = apply_named(rows, config.apply_udf, config.apply_udf_kwargs)
    return infer(todo, config, StubClient(), aligned=True).select(
        "id", "status", finish_reason().alias("finish_reason"), content().alias("content"), *usage_columns()[:3]
    )


@query("infer_completion", f"WITH {SQL_ANSWERS} SELECT {_ANSWER_COLUMNS} FROM answers")
def infer_completion(spark, sf_dir):
    """The request map on whole documents, completion form."""
    config = document_config("unused", api_type="completion", input_column_name="prompt", apply_udf=None, apply_udf_kwargs={})
    rows = documents(spark, sf_dir).select("id", fill(TEMPLATE, document="text").alias("prompt"))
    return infer(rows, config, StubClient()).select(
        "id", "status", finish_reason().alias("finish_reason"), text().alias("content"), *usage_columns()[:3]
    )


def fail_some(n: int) -> str | None:
    """Failures by prompt length, of every class."""
    return {
        0: "Connection refused by host",
        1: "maximum Context Length is 16384",
        2: "timeout",
        3: "bad request",
        4: "too many tokens, connection closed",
    }.get(n % 11)


@query(
    "outcomes_with_errors",
    f"""
WITH {SQL_ANSWERS}
SELECT shard, count(*) FILTER (n % 11 > 4) AS new, count(*) FILTER (n % 11 <= 4) AS errors,
  count(*) FILTER (n % 11 = 2) AS timeout_errors, count(*) FILTER (n % 11 IN (1, 4)) AS context_length_errors,
  count(*) FILTER (n % 11 = 0) AS api_errors, count(*) FILTER (n % 11 = 3) AS other_errors, CAST(0 AS BIGINT) AS aborted
FROM answers GROUP BY shard
""",
)
def outcomes_with_errors(spark, sf_dir):
    """Failing requests become error rows and the rest goes on."""
    config = document_config("unused", max_consecutive_failures=1_000_000_000)
    rows = apply_named(documents(spark, sf_dir).select("id", "text"), config.apply_udf, config.apply_udf_kwargs)
    return outcome_counts(infer(rows, config, StubClient(fail_some)), "shard")


@query(
    "score_by_lang",
    f"""
WITH {SQL_ANSWERS}
SELECT lang, count(*) AS num_docs, count(*) AS responded, CAST(sum(n % 6) AS BIGINT) AS score_sum,
  CAST(sum(total_tokens) AS BIGINT) AS total_tokens
FROM answers GROUP BY lang
""",
)
def score_by_lang(spark, sf_dir):
    """A run from documents to scores: send, store, join back, parse, aggregate."""
    answers = read_responses(spark, document_results(spark, sf_dir))
    scored = join_back(
        documents(spark, sf_dir).select("id", "lang"),
        answers,
        columns={
            "score": parse_score(strip_think(content())),
            "tokens": F.col("response.usage.total_tokens"),
        },
    )
    return scored.groupBy("lang").agg(
        F.count(F.lit(1)).alias("num_docs"),
        F.count_if("responded").alias("responded"),
        F.sum("score").alias("score_sum"),
        F.sum("tokens").alias("total_tokens"),
    )


@query(
    "join_back",
    f"""
WITH {SQL_ANSWERS}
SELECT a.id, d.source, n % 6 AS score, TRUE AS responded FROM answers a JOIN documents d ON d.doc_id = a.doc_id
""",
)
def join_back_documents(spark, sf_dir):
    """Each input row with the score of its response."""
    answers = read_responses(spark, document_results(spark, sf_dir))
    score = parse_score(strip_think(content())).cast("bigint")
    return join_back(documents(spark, sf_dir).select("id", "source"), answers, columns={"score": score})


@query("existing_ids", "SELECT CAST(doc_id AS VARCHAR) AS id FROM documents")
def existing_ids(spark, sf_dir):
    """Ids that an output table already answers."""
    return done_ids(read_results(spark, document_results(spark, sf_dir)))


@query("read_outputs", f"WITH {SQL_ANSWERS} SELECT id, content FROM answers ORDER BY id LIMIT 20")
def read_outputs(spark, sf_dir):
    """The first rows of an output table, by id."""
    rows = read_responses(spark, document_results(spark, sf_dir))
    return rows.select("id", content().alias("content")).orderBy("id").limit(20)


@query(
    "response_sink",
    f"""
WITH {SQL_ANSWERS}
SELECT shard, count(*) AS num_rows, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
  CAST(sum(length(content)) AS BIGINT) AS content_chars FROM answers GROUP BY shard
""",
)
def response_sink(spark, sf_dir):
    """What the partitioned output table holds, per shard."""
    rows = read_results(spark, document_results(spark, sf_dir))
    return rows.groupBy("shard").agg(
        F.count(F.lit(1)).alias("num_rows"),
        F.sum("response.usage.prompt_tokens").alias("prompt_tokens"),
        F.sum(F.length(content())).alias("content_chars"),
    )


@query("file_inventory", f"WITH {SQL_ANSWERS} SELECT shard, count(*) AS num_rows FROM answers GROUP BY shard")
def inventory(spark, sf_dir):
    """Rows per shard, from the files' own counts."""
    rows = file_inventory(spark, document_results(spark, sf_dir))
    return rows.groupBy("shard").agg(F.sum("num_rows").alias("num_rows"))


@query(
    "first_choice_fields",
    f"WITH {SQL_ANSWERS} SELECT id, CAST(0 AS INTEGER) AS index, 'assistant' AS role, content, n % 6 AS score FROM answers",
)
def first_choice_fields(spark, sf_dir):
    """Nested reads of the first choice; only the leaves asked for are scanned."""
    rows = read_results(spark, document_results(spark, sf_dir))
    choice = first_choice()
    return rows.select(
        "id",
        choice["index"].alias("index"),
        choice["message"]["role"].alias("role"),
        content().alias("content"),
        parse_score(content()).cast("bigint").alias("score"),
    )


@query(
    "usage_flatten",
    f"""
WITH {SQL_ANSWERS}
SELECT id, prompt_tokens, completion_tokens, total_tokens, CAST(NULL AS INTEGER) AS reasoning_tokens,
  CAST(NULL AS INTEGER) AS cached_tokens FROM answers
""",
)
def usage_flatten(spark, sf_dir):
    rows = read_results(spark, document_results(spark, sf_dir))
    flat = rows.select("id", *usage_columns())
    return flat.select("id", "prompt_tokens", "completion_tokens", "total_tokens", "reasoning_tokens", "cached_tokens")


@query(
    "explode_choices",
    """
SELECT conv_id AS id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS choice_pos,
  md5(text) AS text_md5 FROM conversations WHERE role = 'assistant'
UNION ALL
SELECT conv_id, NULL, NULL FROM conversations GROUP BY conv_id HAVING NOT bool_or(role = 'assistant')
""",
)
def explode_choices(spark, sf_dir):
    """One row per choice, with the assistant turns of a conversation as its choices."""
    turns = table(spark, sf_dir, "conversations")
    answer = F.when(F.col("role") == "assistant", F.struct("turn", F.col("text")))
    grouped = turns.groupBy(F.col("conv_id").alias("id")).agg(F.sort_array(F.collect_list(answer)).alias("answers"))
    options = F.to_json(F.struct(F.transform("answers", lambda a: F.struct(a["text"].alias("text"))).alias("choices")))
    rows = grouped.select("id", F.from_json(options, one_line(COMPLETION_RESPONSE)).alias("response"))
    return choices(rows).select("id", "choice_pos", F.md5("choice.text").alias("text_md5"))


@query(
    "strip_think",
    "SELECT doc_id, md5(text) AS text_md5 FROM documents",
)
def strip_think_blocks(spark, sf_dir):
    """Think blocks with line breaks, before and inside the text, are taken out whole."""
    docs = table(spark, sf_dir, "documents")
    wrapped = F.concat(F.lit("<think>first\nlines\n</think>\n\n"), F.col("text"), F.lit("<think>second</think>"))
    return docs.select("doc_id", F.md5(strip_think(wrapped)).alias("text_md5"))


@query(
    "translated_text",
    r"""
SELECT doc_id, doc_id % 3 <> 0 AS closed,
  md5(regexp_replace(text, '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g')) AS text_md5 FROM documents
""",
)
def translated_text(spark, sf_dir):
    """The text before the closing tag; every third reply is cut off before it."""
    docs = table(spark, sf_dir, "documents")
    tail = F.when(F.col("doc_id") % 3 != 0, "\n</translated_document>\nthanks").otherwise("\n")
    reply = F.concat(F.lit("\n"), F.col("text"), tail)
    return docs.select(
        "doc_id",
        has_tag(reply, "translated_document").alias("closed"),
        F.md5(until_tag(reply, "translated_document")).alias("text_md5"),
    )


@query(
    "dedupe_responses",
    """
SELECT user_id AS id, event_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1
""",
)
def dedupe_responses(spark, sf_dir):
    """The last attempt of each id, with users as ids and events as attempts."""
    attempts = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"), "event_id", "event_type", F.col("ts").alias("finished_at"), F.col("event_id").alias("wave")
    )
    return latest_per_id(attempts).select("id", "event_id", "event_type")


@query(
    "repeated_attempts",
    f"""
WITH {SQL_ANSWERS}
SELECT count(*) * 2 AS num_rows, count(*) AS num_ids, count(*) AS surplus_rows, count(*) AS kept_rows,
  CAST(sum(prompt_tokens) AS BIGINT) AS kept_tokens FROM answers
""",
)
def repeated_attempts(spark, sf_dir):
    """A table that holds every attempt twice, and what is left with one row per id."""
    path = scratch_path(spark, "repeated")
    once = read_results(spark, document_results(spark, sf_dir))
    append_results(once, path)
    append_results(once, path)
    counts = id_counts(read_results(spark, path).select("id"))
    kept = read_responses(spark, path).agg(
        F.count(F.lit(1)).alias("kept_rows"), F.sum("response.usage.prompt_tokens").alias("kept_tokens")
    )
    # Two frames of one row each, put side by side on a constant key.
    return counts.withColumn("k", F.lit(1)).join(kept.withColumn("k", F.lit(1)), "k").drop("k")


_SQL_LOG_SUMS = """
SELECT shard, count(*) AS num_rows, CAST(sum(CAST(id AS BIGINT)) AS BIGINT) AS id_sum,
  CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS token_sum, count(DISTINCT id) AS num_ids,
  count(DISTINCT CAST(id AS BIGINT) % 8) AS files_before,
  CAST(CASE WHEN count(DISTINCT CAST(id AS BIGINT) % 8) > 5 THEN 1 ELSE count(DISTINCT CAST(id AS BIGINT) % 8) END AS BIGINT)
    AS files_after
FROM log GROUP BY shard
"""


@query("compact_multiset", f"WITH {SQL_LOG} {_SQL_LOG_SUMS}")
def compact_multiset(spark, sf_dir):
    """A log appended in eight waves, then compacted: the same rows in fewer files, both counted."""
    path = scratch_path(spark, "compacted")
    log = event_log(spark, sf_dir)
    # Eight appends' worth of files at once: one file per shard and eighth.
    append_results(log.repartitionById(8, (F.col("id").cast("bigint") % 8).cast("int")), path)

    def files_of(name: str):
        return materialize(file_inventory(spark, path).groupBy("shard").agg(F.count(F.lit(1)).alias(name)), name)

    before = files_of("files_before")
    compact(spark, path, max_files=5)
    sums = spark.read.parquet(path).groupBy("shard").agg(
        F.count(F.lit(1)).alias("num_rows"),
        F.sum(F.col("id").cast("bigint")).alias("id_sum"),
        F.coalesce(F.sum(F.col("total_tokens").cast("bigint")), F.lit(0)).alias("token_sum"),
        F.countDistinct("id").alias("num_ids"),
    )
    return sums.join(before, "shard").join(files_of("files_after"), "shard")


@query(
    "wave_run",
    f"""
WITH {SQL_ANSWERS}
SELECT shard, count(*) AS num_rows, count(DISTINCT id) AS num_ids, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
  CAST(3 AS BIGINT) AS num_waves FROM answers GROUP BY shard
""",
)
def wave_run(spark, sf_dir):
    """A run in three waves, each a committed append."""
    path = scratch_path(spark, "waves-out")
    run(spark, document_config(path), StubClient(), documents(spark, sf_dir), num_waves=3)
    return read_results(spark, path).groupBy("shard").agg(
        F.count(F.lit(1)).alias("num_rows"),
        F.countDistinct("id").alias("num_ids"),
        F.sum("response.usage.prompt_tokens").alias("prompt_tokens"),
        F.countDistinct("wave").alias("num_waves"),
    )


@query(
    "resumed_run",
    f"WITH {SQL_ANSWERS} SELECT lang, count(*) AS num_rows, count(DISTINCT id) AS num_ids FROM answers GROUP BY lang",
)
def resumed_run(spark, sf_dir):
    """A run over the whole table after one over labelled documents only: each id once."""
    path = scratch_path(spark, "resumed")
    docs = documents(spark, sf_dir)
    labelled = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    run(spark, document_config(path), StubClient(), labelled)
    run(spark, document_config(path), StubClient(), docs)
    return join_back(docs.select("id", "lang"), read_results(spark, path), how="inner", columns={}).groupBy("lang").agg(
        F.count(F.lit(1)).alias("num_rows"), F.countDistinct("id").alias("num_ids")
    )


@query(
    "adopted_responses",
    f"""
WITH {SQL_ANSWERS}
SELECT shard, count(*) AS num_rows, count(DISTINCT id) AS num_ids, CAST(sum(total_tokens) AS BIGINT) AS total_tokens
FROM answers GROUP BY shard
""",
)
def adopted_responses(spark, sf_dir):
    """Plain response files of some documents taken over by a results table, then a run for the rest."""
    plain, path = scratch_path(spark, "plain"), scratch_path(spark, "adopted")
    docs = documents(spark, sf_dir)
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id")).distinct()
    answers = read_responses(spark, document_results(spark, sf_dir))
    export_responses(answers.join(labelled, "id", "left_semi"), plain)
    adopt_responses(read_plain_responses(spark, plain), path, NUM_SHARDS)
    run(spark, document_config(path), StubClient(), docs)
    return read_results(spark, path).groupBy("shard").agg(
        F.count(F.lit(1)).alias("num_rows"),
        F.countDistinct("id").alias("num_ids"),
        F.sum("response.usage.total_tokens").alias("total_tokens"),
    )


@query(
    "usage_totals",
    f"""
WITH {SQL_LOG}
SELECT shard, count(*) AS requests, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
  CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens
FROM log WHERE status = 'ok' GROUP BY shard
""",
)
def usage(spark, sf_dir):
    return usage_totals(event_log(spark, sf_dir), "shard")


@query(
    "run_usage",
    f"""
WITH {SQL_ANSWERS}
SELECT count(*) AS requests, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
  CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM answers
""",
)
def run_usage(spark, sf_dir):
    """Token totals of a stored run; reads the usage leaves only."""
    return usage_totals(request_log(read_results(spark, document_results(spark, sf_dir))))


@query(
    "outcome_counts",
    f"""
WITH {SQL_LOG}
SELECT shard, count(*) FILTER (status = 'ok') AS new, count(*) FILTER (status = 'error') AS errors,
  CAST(0 AS BIGINT) AS timeout_errors, count(*) FILTER (error_class = 'context_length') AS context_length_errors,
  count(*) FILTER (error_class = 'api') AS api_errors, count(*) FILTER (error_class = 'other') AS other_errors,
  CAST(0 AS BIGINT) AS aborted
FROM log GROUP BY shard
""",
)
def outcomes(spark, sf_dir):
    return outcome_counts(event_log(spark, sf_dir), "shard")


@query("error_class_counts", f"WITH {SQL_LOG} SELECT error_class, error_text, count(*) AS n FROM log WHERE status = 'error' GROUP BY 1, 2")
def error_class_counts(spark, sf_dir):
    log = event_log(spark, sf_dir).where("status = 'error'")
    return log.groupBy(error_class("error_text").alias("error_class"), "error_text").agg(F.count(F.lit(1)).alias("n"))


@query(
    "completeness",
    """
WITH rows AS (
  SELECT CAST(d.doc_id % 4 AS INTEGER) AS shard, d.doc_id, l.quality, l.doc_id IS NOT NULL AS tried
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
counts AS (
  SELECT shard, count(*) AS total, count(*) FILTER (tried AND quality = 1) AS succeeded,
    count(*) FILTER (tried AND quality <> 1) AS failed FROM rows GROUP BY shard)
SELECT shard, total, succeeded, failed, CAST(0 AS BIGINT) AS aborted, succeeded + failed >= total AS complete,
  CAST(succeeded AS DOUBLE) / total AS success_ratio FROM counts
""",
)
def completeness(spark, sf_dir):
    """Labelled documents as attempts, good ones as successes."""
    shard = (F.col("doc_id") % 4).cast("int").alias("shard")
    totals = shard_totals(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), shard))
    log = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), shard, F.when(F.col("quality") == 1, "ok").otherwise("error").alias("status")
    )
    return shard_completion(totals, log)


@query("stream_infer", f"WITH {SQL_ANSWERS} SELECT id, content, total_tokens FROM answers")
def stream_infer(spark, sf_dir):
    """Documents annotated as arriving files."""
    folder, path = scratch_path(spark, "arrivals"), scratch_path(spark, "stream-out")
    docs = documents(spark, sf_dir).select("id", "text")
    arrivals = read_arrivals(spark, folder, docs.schema, max_files_per_trigger=_save_arrivals(docs, folder))
    annotate_stream(arrivals, document_config(path), StubClient(), scratch_path(spark, "stream-state")).awaitTermination()
    rows = read_responses(spark, path)
    return rows.select("id", content().alias("content"), F.col("response.usage.total_tokens").alias("total_tokens"))


# Files of arriving documents, and how many of them a batch takes at most: a task's share of a batch has a bound.
ARRIVAL_ROWS, ARRIVALS_PER_BATCH = 25_000, 16


def _save_arrivals(docs, folder):
    """Documents as files of even size, without a shuffle; returns how many files make two batches or more."""
    num_rows = docs.count()
    per_file = max(1, min(ARRIVAL_ROWS, -(-num_rows // 4)))
    docs.write.option("maxRecordsPerFile", per_file).parquet(folder)
    return max(1, min(ARRIVALS_PER_BATCH, -(-num_rows // per_file) // 2))


SQL_ONE_ANSWER = "SELECT CAST(doc_id AS VARCHAR) AS id, CAST(1 AS BIGINT) AS answers FROM documents"


def _answers(spark, path):
    ok = read_results(spark, path).where("status = 'ok'")
    return ok.groupBy("id").agg(F.count(F.lit(1)).alias("answers"))


@query("stream_recovers", SQL_ONE_ANSWER)
def stream_recovers(spark, sf_dir):
    """A stream whose endpoint is down at first: after a restart every document is answered once."""
    folder, path, state = (scratch_path(spark, name) for name in ("arrivals", "recovered", "stream-state"))
    docs = documents(spark, sf_dir).select("id", "text")
    per_batch = _save_arrivals(docs, folder)
    config = document_config(path, max_consecutive_failures=3)
    for client in (StubClient(fail=_refused), StubClient()):
        arrivals = read_arrivals(spark, folder, docs.schema, max_files_per_trigger=per_batch)
        try:
            annotate_stream(arrivals, config, client, state).awaitTermination()
        except StreamingQueryException as stopped:
            if "rows not sent" not in str(stopped):
                raise
    return _answers(spark, path)


@query("rate_limited_then_resumed", SQL_ONE_ANSWER)
def rate_limited_then_resumed(spark, sf_dir):
    """A third of the requests meet a rate limit that speaks of tokens; the next run sends them again."""
    path = scratch_path(spark, "rate-limited")
    for client in (StubClient(fail=_rate_limited), StubClient()):
        run(spark, document_config(path), client, documents(spark, sf_dir))
    return _answers(spark, path)


@query(
    "wave_salvage",
    """
SELECT CAST(doc_id AS VARCHAR) AS id, CAST(1 AS BIGINT) AS answers, max(n_chars) OVER () > 0 AS some_kept FROM documents
""",
)
def wave_salvage(spark, sf_dir):
    """A wave whose last task dies keeps what the others answered; the next run sends the rest, each document once."""
    path = scratch_path(spark, "salvaged")
    docs = documents(spark, sf_dir)
    config = document_config(path, api_base_url=",".join(f"http://host-{i}/v1" for i in range(NUM_SHARDS)))
    try:
        run(spark, config, _dying(spark, config), docs, num_waves=1)
    except PySparkException as died:
        if "no such host" not in str(died):
            raise
    kept = read_results(spark, path).where("status = 'ok'").count()
    run(spark, config, StubClient(), docs, num_waves=1)
    return _answers(spark, path).withColumn("some_kept", F.lit(kept > 0))


class _FailsAt:
    """Fails the tasks that ask for one endpoint, once the others have written their files."""

    def __init__(self, endpoint: str, table: str | None, others: int = 0) -> None:
        self.endpoint, self.table, self.others = endpoint, table, others

    def __call__(self, endpoint: str):
        if endpoint == self.endpoint:
            self.wait()
            raise ValueError(f"no such host: {endpoint}")
        return StubClient()

    def wait(self, most: float = 3600.0) -> None:
        """Until complete files are all there is for some seconds: more of them if a task has none yet."""
        began = since = time.time()
        seen: dict[str, bool] = {}
        while time.time() - since < (3 if not self.table or len(seen) >= self.others else 15):
            time.sleep(0.2)
            now = files_in_progress(self.table) if self.table else {}
            if now != seen or not all(now.values()):
                seen, since = now, time.time()
            if time.time() - began > most:
                return


def _dying(spark, config):
    """The client whose first endpoint kills its tasks."""
    others = (config.num_shards - 1) * config.tasks_per_shard
    return _FailsAt(config.endpoints[0], direct(spark, config.output_path), others)


@query(
    "resume_indexed",
    f"""
WITH {SQL_ANSWERS}
SELECT lang, count(*) AS num_rows, count(DISTINCT id) AS num_ids, CAST(0 AS BIGINT) AS left_over FROM answers GROUP BY lang
""",
)
def resume_indexed(spark, sf_dir):
    """Labelled documents first, then all, then all again, each run joined with the bucketed index of what is done."""
    path = scratch_path(spark, "indexed")
    docs = documents(spark, sf_dir)
    labelled = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    for rows in (labelled, docs):
        run(spark, document_config(path), StubClient(), rows, resume_index=True)
    with IdIndex(spark, path) as index:
        index.refresh()
        rest = materialize(pending(docs, index.done()).select("lang"), "left-over")
    left = rest.groupBy("lang").agg(F.count(F.lit(1)).alias("rest"))
    answered = join_back(docs.select("id", "lang"), read_results(spark, path), how="inner", columns={})
    counted = answered.groupBy("lang").agg(F.count(F.lit(1)).alias("num_rows"), F.countDistinct("id").alias("num_ids"))
    return counted.join(left, "lang", "left").select(
        "lang", "num_rows", "num_ids", F.coalesce("rest", F.lit(0)).alias("left_over")
    )


@query(
    "ledger_round_trip",
    """
SELECT CAST(s AS INTEGER) AS shard, s <> 0 AS completed_at_first, CASE WHEN s = 0 THEN 'inference_script_failed' END AS reason,
  true AS completed FROM range(4) r(s)
""",
)
def ledger_round_trip(spark, sf_dir):
    """A run that fails in one shard, and a second one over the shards that its ledger leaves open."""
    path, ledger = scratch_path(spark, "with-ledger"), scratch_path(spark, "ledger")
    docs = documents(spark, sf_dir)
    config = document_config(path, api_base_url=",".join(f"http://host-{i}/v1" for i in range(NUM_SHARDS)))
    try:
        run(spark, config, _dying(spark, config), docs, num_waves=1, ledger_path=ledger)
    except PySparkException as died:
        if "no such host" not in str(died):
            raise
    first = materialize(read_ledger(spark, f"{ledger}/completed"), "completed").withColumn("first", F.lit(True))
    rest = [r.shard for r in next_shards(spark, config, ledger).collect()]
    run(spark, config, StubClient(), docs, num_waves=1, ledger_path=ledger, shards=rest)
    failed = read_ledger(spark, f"{ledger}/failed", "failed").groupBy("shard").agg(F.max("reason").alias("reason"))
    last = read_ledger(spark, f"{ledger}/completed").withColumn("last", F.lit(True))
    return all_shards(spark, NUM_SHARDS).join(first, "shard", "left").join(failed, "shard", "left").join(
        last, "shard", "left"
    ).select(
        "shard", F.coalesce("first", F.lit(False)).alias("completed_at_first"), "reason",
        F.coalesce("last", F.lit(False)).alias("completed"),
    )


@query(
    "progress_of_failed_run",
    f"WITH {SQL_ANSWERS} SELECT shard, count(*) AS completed, count(*) AS total FROM answers WHERE shard <> 0 GROUP BY shard",
)
def progress_of_failed_run(spark, sf_dir):
    """The last progress record of each shard that answered, of a run whose wave failed."""
    path, log = scratch_path(spark, "failed"), scratch_path(spark, "failed-progress")
    config = document_config(path, api_base_url=",".join(f"http://host-{i}/v1" for i in range(NUM_SHARDS)))
    try:
        run(spark, config, _dying(spark, config), documents(spark, sf_dir), num_waves=1, progress_path=log)
    except PySparkException as died:
        if "no such host" not in str(died):
            raise
    rows = read_progress(spark, log)
    return rows.groupBy("shard").agg(
        F.max("completed").alias("completed"), F.max("total").alias("total")
    )


@query(
    "own_shards_run",
    "SELECT CAST(doc_id % 4 AS INTEGER) AS shard, count(*) AS answered FROM documents GROUP BY 1",
)
def own_shards_run(spark, sf_dir):
    """A run over an input that brings its own shards; it ends with the completeness check by them."""
    path = scratch_path(spark, "own-shards")
    rows = documents(spark, sf_dir).withColumn("shard", (F.col("doc_id") % 4).cast("int"))
    run(spark, document_config(path), StubClient(), rows)
    ok = read_results(spark, path).where("status = 'ok'")
    return ok.groupBy("shard").agg(F.count(F.lit(1)).alias("answered"))


def _refused(n: int) -> str:
    return "Connection refused"


def _rate_limited(n: int) -> str | None:
    return "Error code: 429 - too many tokens per minute" if n % 3 == 0 else None
