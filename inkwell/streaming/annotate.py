"""Annotating files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from inkwell.config import RunConfig
from inkwell.operators.infer import ClientFactory, align, infer
from inkwell.operators.resume import pending
from inkwell.operators.transforms import apply_named
from inkwell.plans.run import BreakerTripped
from inkwell.session import tune
from inkwell.sinks.id_index import IdIndex
from inkwell.sinks.tables import append_results
from inkwell.sources.responses import done_ids, read_results


def read_arrivals(
    spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", max_files_per_trigger: int = 1000
) -> DataFrame:
    """A stream of the files in a folder, a bounded number per batch."""
    return (
        spark.readStream.format(fmt)
        .schema(schema)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .load(path)
    )


def annotate_stream(
    arrivals: DataFrame,
    config: RunConfig,
    client_factory: ClientFactory,
    checkpoint: str,
    run_id: str = "stream",
    done_scope: str = "table",
    available_now: bool = True,
    interval: str = "60 seconds",
) -> StreamingQuery:
    """Send a request for each arriving row without a response, and append the results.

    A batch may be run again after a failure; the anti-join then finds what the
    first try wrote. A batch whose breaker trips fails the query after its rows are written,
    and is not committed. `done_scope="table"` looks for a batch's ids in the whole
    output table; `"index"` in its bucketed index, which is brought up to date by the files that are new since the last
    batch, so a batch costs the same however long the table is; `"batch"` only in what the same batch wrote before, for long
    streams whose ids do not come twice. With `available_now` the query ends when
    no file is left.
    """
    if done_scope not in ("table", "index", "batch"):
        raise ValueError("done_scope must be 'table', 'index' or 'batch'")
    tune(arrivals.sparkSession)

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        if done_scope == "index":
            with IdIndex(session, config.output_path, config.api_type) as index:
                index.refresh()
                send(pending(batch, index.done(), config.id_column_name), batch_id)
            return
        results = read_results(session, config.output_path, config.api_type)
        if done_scope == "batch":
            results = results.where((F.col("run_id") == run_id) & (F.col("wave") == batch_id))
        # The batch is the small side: keep only its ids of what is done.
        own = batch.select(F.col(config.id_column_name).alias("id")).distinct()
        done = done_ids(results).join(own, "id", "left_semi")
        send(pending(batch, done, config.id_column_name), batch_id)

    def send(rows: DataFrame, batch_id: int) -> None:
        dealt = align(rows, config)
        todo = apply_named(dealt, config.apply_udf, config.apply_udf_kwargs)
        results = infer(todo, config, client_factory, run_id, batch_id, aligned=True)
        seen = Observation()
        append_results(
            results.observe(seen, F.count_if(F.col("status") == "aborted").alias("aborted")), config.output_path
        )
        if aborted := seen.get.get("aborted"):
            # Not committed: the next start runs this batch again and sends what has no final outcome.
            raise BreakerTripped(f"endpoint appears to be down: {aborted} rows not sent in batch {batch_id}")

    writer = arrivals.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()
