"""Assigning rows to shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.functions.sharding import block_shard, check_shard, hash_shard
from inkwell.operators.ordering import (
    MAX_BROADCAST_ROWS,
    chunk_offsets,
    ordered_chunks,
    with_file_position,
)


def with_shard(
    df: DataFrame, num_shards: int, mode: str = "hash", id_col: str = "id", into: str = "shard"
) -> DataFrame:
    """Add a shard column.

    hash        from the id; no data moves, and a row keeps its shard as data is
                added. The default.
    contiguous  equal blocks of rows as stored in sorted files; no data moves.
    file        whole files, round robin over the sorted file list.
    """
    if num_shards < 1:
        raise ValueError("num_shards must be at least 1")
    if mode == "hash":
        return df.withColumn(into, hash_shard(id_col, num_shards))
    if mode == "contiguous":
        num_rows = df.count()
        placed = with_file_position(df, "_position")
        return placed.withColumn(into, block_shard("_position", num_rows, num_shards)).drop("_position")
    if mode == "file":
        return _by_file(df, num_shards, into)
    raise ValueError(f"unknown sharding mode {mode!r}")


def _by_file(df: DataFrame, num_shards: int, into: str) -> DataFrame:
    paths = df.inputFiles()
    if num_shards > len(paths):
        raise ValueError(f"cannot have more shards ({num_shards}) than data files ({len(paths)})")
    listed = df.select(F.col("_metadata.file_path").alias("_file")).distinct()
    numbered = listed.select(
        "_file",
        ((F.row_number().over(W.orderBy("_file")) - 1) % num_shards).cast("int").alias(into),
    )
    if len(paths) <= MAX_BROADCAST_ROWS:
        numbered = F.broadcast(numbered)
    located = df.select("*", F.col("_metadata.file_path").alias("_file"))
    return located.join(numbered, "_file").drop("_file")


def contiguous_by_key(df: DataFrame, num_shards: int, key: str = "id", into: str = "shard") -> DataFrame:
    """Equal contiguous blocks in key order: key and shard, first blocks one row longer.

    Only the key column is ordered, over range chunks; join back on the key, or
    use `with_shard(mode="contiguous")` where stored order will do.
    """
    chunked = ordered_chunks(df.select(key), [key])
    num_rows = chunked.count()
    offsets = F.broadcast(chunk_offsets(chunked))  # one row per chunk
    position = F.col("offset") + F.col("chunk_pos")
    return chunked.join(offsets, "chunk").select(key, block_shard(position, num_rows, num_shards).alias(into))


def select_shard(df: DataFrame, shard: int | None, num_shards: int | None, into: str = "shard") -> DataFrame:
    """Rows of one shard; all rows when `shard` is None."""
    check_shard(shard, num_shards)
    return df if shard is None else df.where(F.col(into) == shard)


def shard_sizes(df: DataFrame, num_shards: int, shard_col: str = "shard") -> DataFrame:
    """Rows per shard, empty shards included."""
    counts = df.groupBy(shard_col).agg(F.count(F.lit(1)).alias("num_rows"))
    shards = df.sparkSession.range(num_shards).select(F.col("id").cast("int").alias(shard_col))
    return shards.join(counts, shard_col, "left").select(shard_col, F.coalesce("num_rows", F.lit(0)).alias("num_rows"))
