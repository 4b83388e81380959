"""Progress and breaker of a streamed request log, as state per shard.

Rows are first gathered by shard and interval, behind a watermark, so that late ones are in their place and a shard's state sees
an interval once, in order, however many requests it had. The state of a shard is a handful of numbers: running
sums, or the length of the streak it is in.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from inkwell.functions.errors import BREAKER_CLASSES
from inkwell.operators.outcomes import TOKENS
from inkwell.sources.shipping import ship_package

# Processors are also opened once on the driver, in a worker that does not get the shipped package: send them by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

AMOUNTS = ("new", "errors", *TOKENS)
FIRSTS = ("first_ok", "first_start")
_SUMS = ", ".join(f"{name} bigint" for name in (*AMOUNTS, *FIRSTS))
INTERVALS = (
    f"shard int, bucket bigint, {', '.join(f'interval_{name} bigint' for name in AMOUNTS)}, {_SUMS}"
)


class RunningSums(StatefulProcessor):
    """Adds up the intervals of a shard and fills the empty ones between two."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.so_far = handle.getValueState("so_far", f"bucket bigint, {_SUMS}")

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:
        known = self.so_far.get() if self.so_far.exists() else None
        last, sums, firsts = None, [0] * len(AMOUNTS), [None] * len(FIRSTS)
        if known is not None:
            last, sums, firsts = known[0], list(known[1 : 1 + len(AMOUNTS)]), list(known[1 + len(AMOUNTS) :])
        for row in sorted(rows, key=lambda r: r.bucket):
            for empty in range(row.bucket if last is None else last + 1, row.bucket):
                yield self._report(key, empty, [0] * len(AMOUNTS), sums, firsts)
            amounts = [getattr(row, name) for name in AMOUNTS]
            sums = [a + b for a, b in zip(sums, amounts, strict=True)]
            firsts = [_least(a, getattr(row, name)) for a, name in zip(firsts, FIRSTS, strict=True)]
            last = row.bucket
            yield self._report(key, last, amounts, sums, firsts)
        if last is not None:
            self.so_far.update((last, *sums, *firsts))

    @staticmethod
    def _report(key, bucket, amounts, sums, firsts) -> Row:
        names = ["shard", "bucket", *[f"interval_{name}" for name in AMOUNTS], *AMOUNTS, *FIRSTS]
        return Row(**dict(zip(names, [key[0], bucket, *amounts, *sums, *firsts], strict=True)))

    def close(self) -> None:
        pass


def _least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def running_intervals(log: DataFrame, interval_s: int = 60, lateness: str = "10 minutes") -> DataFrame:
    """A streamed log's intervals with their running sums, once each, when `lateness` has passed.

    Rows come in the shape that `inkwell.operators.progress.report_rows` takes, but for the choice of the origin.
    """
    ship_package(log.sparkSession)
    ok, micros = F.col("status") == "ok", F.unix_micros("finished_at")
    started = F.unix_micros("started_at") if "started_at" in log.columns else micros
    counts = (
        log.withWatermark("finished_at", lateness)
        .groupBy(F.window("finished_at", f"{interval_s} seconds").alias("window"), "shard")
        .agg(
            F.count_if(ok).alias("new"),
            F.count_if(F.col("status") == "error").alias("errors"),
            *[F.coalesce(F.sum(F.when(ok, F.col(name).cast("bigint"))), F.lit(0)).alias(name) for name in TOKENS],
            F.min(F.when(ok, micros)).alias("first_ok"),
            F.min(started).alias("first_start"),
        )
    )
    bucket = F.call_function("div", F.unix_micros("window.start"), F.lit(interval_s * 1_000_000)).alias("bucket")
    return (
        counts.select("shard", bucket, *AMOUNTS, *FIRSTS)
        .groupBy("shard")
        .transformWithState(RunningSums(), INTERVALS, "append", "none")
    )


TRIPS = "shard int, tripped_at timestamp, id string, streak int"


class Streak(StatefulProcessor):
    """Counts failures in a row, and reports the one at which they first reach `limit`."""

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.streak = handle.getValueState("streak", "length int, tripped boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:
        length, tripped = self.streak.get() if self.streak.exists() else (0, False)
        for row in sorted(rows, key=lambda r: r.bucket):
            for event in row.events:
                length = 0 if event["success"] else length + 1
                if length >= self.limit and not tripped:
                    tripped = True
                    yield Row(shard=key[0], tripped_at=event["finished_at"], id=event["id"], streak=length)
        self.streak.update((length, tripped))

    def close(self) -> None:
        pass


def first_trips(log: DataFrame, limit: int = 20, interval_s: int = 60, lateness: str = "10 minutes") -> DataFrame:
    """The first failure of each shard of a streamed log at which a streak reached `limit`, when `lateness` has passed.

    A shard's rows of one interval are sorted together; an endpoint answers so many requests in a time.
    """
    ship_package(log.sparkSession)
    success = F.col("status") == "ok"
    failure = (F.col("status") == "error") & F.col("error_class").isin(*BREAKER_CLASSES)
    event = F.struct("finished_at", "id", success.alias("success"))
    gathered = (
        log.withWatermark("finished_at", lateness)
        .where(success | F.coalesce(failure, F.lit(False)))
        .groupBy(F.window("finished_at", f"{interval_s} seconds").alias("window"), "shard")
        .agg(F.sort_array(F.collect_list(event)).alias("events"))
    )
    return (
        gathered.select("shard", F.unix_micros("window.start").alias("bucket"), "events")
        .groupBy("shard")
        .transformWithState(Streak(limit), TRIPS, "append", "none")
    )


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def write_stream(
    rows: DataFrame, path: str, checkpoint: str, available_now: bool = True, interval: str = "60 seconds"
) -> StreamingQuery:
    """Append a stream's rows to a parquet table, each once. State per shard needs the RocksDB store; the setting holds
    for this query and is put back."""
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    conf = rows.sparkSession.conf
    before = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKS)
    try:
        return writer.start()  # a query keeps the settings it starts with
    finally:
        conf.set(PROVIDER, before)
