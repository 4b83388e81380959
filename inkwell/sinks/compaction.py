"""Merging the many small files that waves leave behind.

A compaction has one moment at which it happens: when the folder that lists old and new files gets its final
name, by one rename. Before, the table is as it was and merged files lie in a hidden folder. After, whoever comes next,
a reader of this library included, finishes what the list says: new files are moved in, old ones
deleted, then the list goes. Each of these steps can be repeated, and by several at a time, so a stop
between any two of them neither loses rows nor leaves them twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.session import materialize
from inkwell.sinks.tables import file_inventory
from inkwell.sources import files
from inkwell.sources.shared_files import direct, open_store
from inkwell.sources.shipping import ship_package

LISTS = "_compactions"
GROUP = 1000  # shards merged by one job
ACTIONS_PER_TASK = 200


@dataclass(frozen=True)
class Compaction:
    shards: tuple[int, ...]
    files_before: int
    files_after: int
    num_rows: int


def compaction_plan(
    spark: SparkSession, path: str, max_files: int = 5, target_mb: int = 2000, max_rows: int | None = None
) -> DataFrame:
    """Shards with more than `max_files` files that would end with fewer: shard, num_files, target_files."""
    by_size = F.ceil(F.col("num_bytes") / F.lit(target_mb * 1024 * 1024))
    by_rows = F.ceil(F.col("num_rows") / F.lit(max_rows)) if max_rows else F.lit(1)
    return (
        file_inventory(spark, path)
        .groupBy("shard")
        .agg(
            F.count(F.lit(1)).alias("num_files"),
            F.sum("num_bytes").alias("num_bytes"),
            F.sum("num_rows").alias("num_rows"),
        )
        .withColumn("target_files", F.greatest(by_size, by_rows, F.lit(1)).cast("int"))
        .where((F.col("num_files") > max_files) & (F.col("target_files") < F.col("num_files")))
    )


def compact(
    spark: SparkSession, path: str, max_files: int = 5, target_mb: int = 2000, max_rows: int | None = None
) -> Compaction:
    """Rewrite shards that have too many files, in place, `GROUP` shards at a time.

    A large shard is cut into as many tasks as it gets files. Files are moved and deleted by tasks where these reach the
    store themselves. One compaction of a table at a time.
    """
    path = path.rstrip("/")
    finish_open(spark, path)
    for left in files.list_folders(spark, path, "_compacting-"):  # of one that stopped before it happened
        files.delete_folder(spark, f"{path}/{left}")
    plan = materialize(compaction_plan(spark, path, max_files, target_mb, max_rows), "compaction-plan")
    done, last = Compaction((), 0, 0, 0), -1
    while group := plan.where(F.col("shard") > last).orderBy("shard").limit(GROUP).collect():
        last = group[-1].shard
        part = _compact_shards(spark, path, group, max_rows)
        done = Compaction(
            done.shards + part.shards, done.files_before + part.files_before, done.files_after + part.files_after,
            done.num_rows + part.num_rows,
        )
    return done


def _compact_shards(spark: SparkSession, path: str, plan: list, max_rows: int | None) -> Compaction:
    shards, rows_before = [p.shard for p in plan], sum(p.num_rows for p in plan)
    # Partition numbers: each shard owns a run of `target_files` of them.
    first, starts = 0, []
    for p in plan:
        starts.append((p.shard, first, p.target_files))
        first += p.target_files
    layout = F.broadcast(spark.createDataFrame(starts, "shard int, start int, target_files int"))  # at most GROUP rows
    old = materialize(
        file_inventory(spark, path).join(layout, "shard").select(F.lit("old").alias("kind"), _name("file_path")),
        "compaction-old",
    )
    identity = uuid.uuid4().hex
    staging = f"{path}/_compacting-{identity}"
    _write_merged(spark, path, shards, layout, first, staging, max_rows)
    merged = spark.read.option("basePath", staging).parquet(staging)
    rows_after = merged.count()
    if rows_after != rows_before:
        files.delete_folder(spark, staging)
        raise RuntimeError(f"merged files hold {rows_after} rows, expected {rows_before}; table left as it was")
    new = file_inventory(spark, staging).select(F.lit("new").alias("kind"), _name("file_path"))
    files_after = len(merged.inputFiles())
    _commit(spark, path, identity, old.unionByName(new))
    finish_open(spark, path)
    return Compaction(tuple(sorted(shards)), sum(p.num_files for p in plan), files_after, rows_before)


def _name(file_path: str):
    """Shard folder and file name, as they are in the store."""
    return F.url_decode(F.regexp_replace(F.regexp_extract(file_path, r"([^/]+/[^/]+)$", 1), r"\+", "%2B")).alias("name")


def _write_merged(spark, path, shards, layout, tasks, staging, max_rows) -> None:
    table = spark.read.option("basePath", path).parquet(*[f"{path}/shard={s}" for s in shards])
    columns = table.columns
    spread = F.pmod(F.xxhash64("_metadata.file_path", "_metadata.row_index"), F.col("target_files"))
    moved = (
        table.select("*", F.col("_metadata"))
        .join(layout, "shard")
        .withColumn("_target", (F.col("start") + spread).cast("int"))
        .select(*columns, "_target")
        .repartitionById(tasks, "_target")
        .drop("_target")
    )
    writer = moved.write.partitionBy("shard").option("compression", "zstd")
    if max_rows:
        writer = writer.option("maxRecordsPerFile", max_rows)
    writer.parquet(staging)


def _commit(spark: SparkSession, path: str, identity: str, listed: DataFrame) -> None:
    """The moment of the compaction: the written list gets its final name."""
    files.make_folder(spark, f"{path}/{LISTS}")
    hidden = f"{path}/{LISTS}/.{identity}"
    listed.coalesce(1).write.parquet(hidden)
    files.rename(spark, hidden, f"{path}/{LISTS}/{identity}")


def open_lists(spark: SparkSession, path: str) -> list[str]:
    """Compactions that have happened and are not finished."""
    return files.list_folders(spark, f"{path.rstrip('/')}/{LISTS}")


def finish_open(spark: SparkSession, path: str) -> int:
    """Finish what earlier compactions left; returns how many there were."""
    path = path.rstrip("/")
    found = open_lists(spark, path)
    for identity in found:
        staging = f"{path}/_compacting-{identity}"
        listed = spark.read.schema("kind string, name string").parquet(f"{path}/{LISTS}/{identity}")
        moves = listed.where("kind = 'new'").select(
            F.concat(F.lit(f"{staging}/"), "name").alias("source"), F.concat(F.lit(f"{path}/"), "name").alias("target")
        )
        _apply(spark, path, moves)
        deletes = listed.where("kind = 'old'").select(
            F.concat(F.lit(f"{path}/"), "name").alias("source"), F.lit(None).cast("string").alias("target")
        )
        _apply(spark, path, deletes)
        files.delete_folder(spark, f"{path}/{LISTS}/{identity}")
        files.delete_folder(spark, staging)
    return len(found)


def _apply(spark: SparkSession, path: str, actions: DataFrame) -> None:
    """Move (source, target) or, without a target, delete. What is done already is passed over."""
    store = direct(spark, path)
    if store is None:
        files.for_each(lambda a: _act_by_driver(spark, a.source, a.target), list(actions.toLocalIterator()))
        return
    ship_package(spark)

    def act(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _act(store + source[len(path):], target and store + target[len(path):])
            yield pa.record_batch([pa.array([batch.num_rows], type=pa.int64())], names=["n"])

    tasks = max(1, -(-actions.count() // ACTIONS_PER_TASK))
    actions.repartition(tasks).mapInArrow(act, "n bigint").agg(F.sum("n")).collect()


def _act(source: str, target: str | None) -> None:
    """One action in a task, by resolved paths. Another task may be at the same one."""
    store, at = open_store(source)
    if target is None:
        try:
            store.delete_file(at)
        except FileNotFoundError:
            pass
        return
    to = open_store(target)[1]
    store.create_dir(to.rpartition("/")[0], recursive=True)
    try:
        store.move(at, to)
    except FileNotFoundError:
        if store.get_file_info(to).size is None:
            raise


def _act_by_driver(spark: SparkSession, source: str, target: str | None) -> None:
    if not files.exists(spark, source):
        if target is not None and not files.exists(spark, target):
            raise FileNotFoundError(source)
        return
    if target is None:
        files.delete_file(spark, source)
    else:
        files.move_into(spark, source, target.rpartition("/")[0])
