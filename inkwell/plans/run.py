"""A whole run: load, skip what is done, send in waves, write, check."""

from __future__ import annotations

import time
import uuid
import warnings
from collections.abc import Callable, Iterator
from contextlib import ExitStack
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from inkwell.config import RunConfig, api_key
from inkwell.functions.sharding import check_shards, hash_shard
from inkwell.operators.client import HttpClientFactory
from inkwell.operators.infer import ClientFactory, align, infer, row_hash
from inkwell.operators.ledger import failed_lines, shard_ledger, shards_to_submit, write_completed
from inkwell.operators.outcomes import check_complete, request_log, shard_completion, shard_totals
from inkwell.operators.progress import progress, progress_records
from inkwell.operators.resume import pending
from inkwell.operators.shard import with_shard
from inkwell.operators.transforms import apply_named
from inkwell.operators.validate import validate
from inkwell.session import materialize, scratch_path, tune
from inkwell.sinks.id_index import IdIndex
from inkwell.sinks.tables import append_progress, append_results
from inkwell.sources import files
from inkwell.sources.ledgers import read_ledger
from inkwell.sources.inputs import has_row_index, load_configured
from inkwell.sources.responses import done_ids, finished, read_results

_ROW = "_row"
_WAVE = "_wave"

# Ids already done, as stored: while all waves together send no more than this, they are joined
# in every wave (small enough to be broadcast), beyond it once, before the waves are cut.
SMALL_DONE_BYTES = 10 * 1024 * 1024

# Without a number of waves, results are committed about this often. Until a wave has been timed, a request is taken to
# last so long.
COMMIT_SECONDS, REQUEST_SECONDS = 1800, 5

# A wave grows by so much over the one before it, and gives a task no more than about so many rows.
WAVE_GROWTH, TASK_ROWS = 4, 50_000

# Cut waves by file only with so many files for each, or they would be uneven.
FILES_PER_WAVE = 4


@dataclass(frozen=True)
class RunSummary:
    run_id: str
    waves: int
    new: int
    errors: int
    prompt_tokens: int
    completion_tokens: int
    seconds: float


class BreakerTripped(RuntimeError):
    """Too many failures in a row. What was answered before is written."""


def run(
    spark: SparkSession,
    config: RunConfig,
    client_factory: ClientFactory | None = None,
    df: DataFrame | None = None,
    num_waves: int | None = None,
    completion: str = "attempted",
    retry_failed: bool = False,
    validate_sample: int | None = None,
    progress_path: str | None = None,
    progress_interval_s: int = 60,
    max_rows_per_file: int | None = None,
    run_id: str | None = None,
    after_wave: Callable[[int], None] | None = None,
    resume_index: bool = False,
    ledger_path: str | None = None,
    shards: list[int] | None = None,
    shard_by: str = "hash",
    check_unique: bool = False,
) -> RunSummary:
    """Send every row of the input that has no response yet, and append the results.

    Each wave is one Spark job that ends in a committed append, so a stopped run
    loses at most one wave and starts again where it was. A wave that fails keeps what its finished tasks
    wrote. The requests of a wave run in its last stage, which also writes them: nothing is shuffled after a
    request, so a lost executor cannot undo a finished task.

    `shard_by`: `hash` of the id, or `contiguous` or `file`, as the rows are stored; an input's own shards come first.
    `check_unique`: an id that is there twice stops the run before the first request. `shards`: send rows of these only. `ledger_path`: a folder that gets the numbers of completed shards and a line for
    every one that is not, however the run ends; `next_shards` reads it.

    `resume_index` keeps the done ids in a bucketed table beside the results and joins that; the results are not
    read again but for files that are new to it.
    """
    tune(spark)
    if spark.conf.get("spark.speculation", "false") == "true":
        warnings.warn("spark.speculation is on: slow tasks are copied and their requests sent twice")
    began = time.time()
    run_id = run_id or uuid.uuid4().hex
    client_factory = client_factory or HttpClientFactory(config.api_type, api_key(), config.max_retries)
    source = df if df is not None else load_configured(spark, config)
    if shard_by != "hash" and "shard" not in source.columns:
        source = with_shard(source, config.num_shards, shard_by, config.id_column_name)
    if shards is not None:
        source = source.where(_shard_of(source, config).isin(check_shards(shards, config.num_shards)))
    validate(
        _prepared(source, config), config.api_type, config.input_column_name, config.id_column_name,
        mode="fail", sample=validate_sample, completions_kwargs=config.completions_kwargs, check_unique=check_unique,
    )
    scratch = scratch_path(spark, "run")
    records = _Records(spark, config, run_id, source, retry_failed, progress_path, progress_interval_s)
    records.ledger_path, records.completion = ledger_path, completion
    counts = {"new": 0, "errors": 0, "prompt_tokens": 0, "completion_tokens": 0}
    waves = 0
    with ExitStack() as kept_open:
        if resume_index:
            index = kept_open.enter_context(IdIndex(spark, config.output_path, config.api_type))
            index.refresh()
            done, stored = index.done(retry_failed), index.folder
        else:
            earlier = done_ids(read_results(spark, config.output_path, config.api_type), retry_failed)
            # Written once for all waves; its true size then decides how it is joined.
            stored = f"{scratch}/done-ids"
            done = materialize(earlier, "done-ids", path=stored)
        done_bytes = 0 if done.isEmpty() else sum(size for _, size in files.list_files(spark, stored))
        pace = None
        if num_waves is None:
            num_rows = source.count()
            num_waves = default_waves(num_rows, config)
            pace = _Pace(num_rows, num_waves, config)
        todo_before = num_waves > 1 and done_bytes * num_waves > SMALL_DONE_BYTES
        rest = pending(source, done, config.id_column_name) if todo_before else source
        kept_open.push(records.at_the_end)
        for wave, rows in enumerate(_waves(rest, num_waves, f"{scratch}/waves", not todo_before, pace)):
            if done_bytes and not todo_before:
                rows = pending(rows, done, config.id_column_name)
            # Source rows are dealt to tasks; prompts are built after that shuffle.
            dealt = align(rows, config, F.col(_ROW) if _ROW in rows.columns else None).drop(_ROW)
            results = infer(_prepared(dealt, config), config, client_factory, run_id, wave, aligned=True)
            aborted = _write_wave(results, config, counts, max_rows_per_file)
            waves += 1
            if aborted:
                raise BreakerTripped(_down(spark, config, run_id, wave, aborted))
            records.append(complete_only=True)
            if after_wave:
                after_wave(wave)
        if resume_index:
            index.refresh()
    log = request_log(read_results(spark, config.output_path, config.api_type))
    check_complete(records.totals, log, completion, config.min_success_ratio)
    files.delete_folder(spark, scratch)
    return RunSummary(run_id=run_id, waves=waves, seconds=time.time() - began, **counts)


def _down(spark: SparkSession, config: RunConfig, run_id: str, wave: int, aborted: int) -> str:
    """What a tripped breaker says: how many rows were not sent, and of which shards."""
    shards = (
        read_results(spark, config.output_path, config.api_type)
        .where((F.col("run_id") == run_id) & (F.col("status") == "aborted"))
        .select("shard").distinct()
    )
    first = [r.shard for r in shards.orderBy("shard").limit(20).collect()]
    more = shards.count() - len(first)
    return f"endpoint appears to be down: {aborted} rows not sent in wave {wave}, shards {first}" + (
        f" and {more} more" if more else ""
    )


class _Records:
    """Progress records of one run: those of complete intervals after each wave, the rest when the run ends, however it does."""

    def __init__(self, spark, config, run_id, source, retry_failed, path, interval_s) -> None:
        self.spark, self.config, self.run_id, self.retry_failed = spark, config, run_id, retry_failed
        self.path, self.interval_s, self.written_to = path, interval_s, float("-inf")
        self.totals = input_totals(source, config)
        self.ledger_path: str | None = None
        self.completion = "attempted"

    def write_ledger(self) -> None:
        """Completed shards, each once, and a line for each that is not."""
        if not self.ledger_path:
            return
        log = request_log(read_results(self.spark, self.config.output_path, self.config.api_type))
        ledger = materialize(shard_ledger(shard_completion(self.totals, log, self.completion)), "ledger")
        write_completed(ledger, f"{self.ledger_path}/completed")
        now = datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
        failed = failed_lines(ledger, now, self.run_id).coalesce(1)
        failed.write.mode("append").text(f"{self.ledger_path}/failed")

    def append(self, complete_only: bool = False) -> None:
        if not self.path:
            return
        log = request_log(read_results(self.spark, self.config.output_path, self.config.api_type))
        mine = F.col("run_id") == self.run_id
        earlier = shard_totals(finished(log.where(~mine), self.retry_failed)).withColumnRenamed("total", "existing")
        rows = progress(
            log.where(mine), self.totals, self.interval_s, num_shards=self.config.num_shards, existing=earlier
        )
        new = progress_records(rows).where(F.col("timestamp") > self.written_to)
        if complete_only:
            new = new.where(F.col("timestamp") <= time.time())
        new = materialize(new, "progress-records")
        last = new.agg(F.max("timestamp")).first()[0]
        if last is not None:
            append_progress(new.withColumn("run_id", F.lit(self.run_id)), self.path)
            self.written_to = last

    def at_the_end(self, kind, error, trace) -> bool:
        """Records of what was answered, also when a wave failed; that failure is what the caller hears of."""
        try:
            self.append()
            self.write_ledger()
        except Exception as second:  # noqa: BLE001
            if error is None:
                raise
            warnings.warn(f"progress records or the ledger were not written: {second}")
        return False


def default_waves(rows: int, config: RunConfig) -> int:
    """Parts for a commit about every `COMMIT_SECONDS`, at `REQUEST_SECONDS` a request on all connections.

    A wave takes one part, or several where the waves before it were faster than that.
    """
    per_wave = COMMIT_SECONDS * config.max_connections * config.num_inference_servers // REQUEST_SECONDS
    return max(1, -(-rows // max(1, per_wave)))


class _Pace:
    """How many parts the next wave takes: what the last wave's pace does in `COMMIT_SECONDS`."""

    def __init__(self, num_rows: int, num_parts: int, config: RunConfig) -> None:
        tasks = config.num_shards * config.tasks_per_shard
        self.most = max(1, TASK_ROWS * tasks * num_parts // max(1, num_rows))
        self.parts, self.began = 1, None

    def next_parts(self) -> int:
        now = time.time()
        if self.began is not None:
            fitting = int(self.parts * COMMIT_SECONDS / max(now - self.began, 0.001))
            self.parts = max(1, min(fitting, WAVE_GROWTH * self.parts, self.most))
        self.began = now
        return self.parts


def input_totals(source: DataFrame, config: RunConfig) -> DataFrame:
    """Distinct ids per shard of the input; reads the id column only."""
    shard = _shard_of(source, config).alias("shard")
    return shard_totals(source.select(F.col(config.id_column_name).alias("id"), shard))


def _shard_of(source: DataFrame, config: RunConfig) -> Column:
    """The same shard that `align` uses: the input's own, if it brings one."""
    return F.col("shard").cast("int") if "shard" in source.columns else hash_shard(config.id_column_name, config.num_shards)


def next_shards(spark: SparkSession, config: RunConfig, ledger_path: str, limit: int | None = None) -> DataFrame:
    """Shards that no run has completed, the lowest `limit` of them."""
    completed = read_ledger(spark, f"{ledger_path}/completed", "completed")
    return shards_to_submit(config.num_shards, completed, spark.createDataFrame([], "shard int"), limit)


def _prepared(rows: DataFrame, config: RunConfig) -> DataFrame:
    return apply_named(rows, config.apply_udf, config.apply_udf_kwargs)


def _write_wave(
    results: DataFrame, config: RunConfig, counts: dict[str, int], max_rows_per_file: int | None = None
) -> int:
    """Append one wave. Its counts are taken while it is written, without another scan."""
    seen = Observation()
    usage = F.col("response.usage")
    watched = results.observe(
        seen,
        F.count_if(F.col("status") == "ok").alias("new"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.count_if(F.col("status") == "aborted").alias("aborted"),
        F.sum(usage["prompt_tokens"].cast("bigint")).alias("prompt_tokens"),
        F.sum(usage["completion_tokens"].cast("bigint")).alias("completion_tokens"),
    )
    append_results(watched, config.output_path, max_rows_per_file, keep_finished=True)
    values = seen.get
    for name in counts:
        counts[name] += values.get(name) or 0
    return values.get("aborted") or 0


def _waves(
    source: DataFrame, num_parts: int, stage_path: str, by_file: bool = True, pace: _Pace | None = None
) -> Iterator[DataFrame]:
    """The input in `num_parts` parts, each row in exactly one; a wave is one of them, or as many as `pace` says.

    A table with enough files is cut by a hash of the file name, which prunes the
    file list: every wave scans only its own files, and nothing is moved. Any other frame is written once, one folder per
    part in files of even size, so that no wave computes it again.
    """
    located = _located(source)
    if num_parts <= 1:
        yield located
        return
    if by_file and _ROW in located.columns and len(source.inputFiles()) >= FILES_PER_WAVE * num_parts:
        file_part = F.pmod(F.xxhash64("_metadata.file_path"), F.lit(num_parts))
        for first, last in _ranges(num_parts, pace):
            yield _located(source.where(file_part.between(first, last)))
        return
    key = F.col(_ROW) if _ROW in located.columns else row_hash(located)
    part = F.pmod(F.xxhash64(key), F.lit(num_parts))
    cut = located.withColumn(_WAVE, part.cast("int")).hint("rebalance", _WAVE)
    staged = materialize(cut, "waves", _WAVE, path=stage_path)
    for first, last in _ranges(num_parts, pace):
        yield staged.where(F.col(_WAVE).between(first, last)).drop(_WAVE)


def _ranges(num_parts: int, pace: _Pace | None) -> Iterator[tuple[int, int]]:
    """First and last part of each wave."""
    first = 0
    while first < num_parts:
        last = min(num_parts, first + (pace.next_parts() if pace else 1)) - 1
        yield first, last
        first = last + 1


def _located(df: DataFrame) -> DataFrame:
    """Add a row key from file and row number where the frame is a parquet table."""
    if not has_row_index(df):
        return df
    return df.select("*", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias(_ROW))
