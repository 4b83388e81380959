"""Row positions in a global order, without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.session import materialize

# A broadcast file list or chunk list is at most this long; see `file_offsets`.
MAX_BROADCAST_ROWS = 100_000

_TIE = "_tie"


def num_chunks(df: DataFrame) -> int:
    return min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MAX_BROADCAST_ROWS)


def ordered_chunks(df: DataFrame, order_by: list[str], chunks: int | None = None) -> DataFrame:
    """`df` cut into range chunks of the order, written once.

    Adds `chunk` (0, 1, ... in order) and `chunk_pos` (position inside it). A
    tie-break column lets a value that fills many chunks be split, so no chunk
    grows with a hot value. Select narrow columns before calling this.
    """
    chunks = chunks or num_chunks(df)
    keyed = df.withColumn(_TIE, F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange(chunks, *order_by, _TIE).sortWithinPartitions(*order_by, _TIE)
    # The low 33 bits of monotonically_increasing_id count rows in a partition.
    placed = ordered.drop(_TIE).select(
        "*",
        F.spark_partition_id().alias("chunk"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("chunk_pos"),
    )
    return materialize(placed, "ordered")


def chunk_offsets(chunked: DataFrame) -> DataFrame:
    """Rows before each chunk. The window runs over one row per chunk."""
    counts = chunked.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
    before = W.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    return counts.select("chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))


def with_position(df: DataFrame, order_by: list[str], into: str = "position", chunks: int | None = None) -> DataFrame:
    """Zero-based row number in the given order."""
    chunked = ordered_chunks(df, order_by, chunks)
    # One row per chunk, at most MAX_BROADCAST_ROWS by construction.
    offsets = F.broadcast(chunk_offsets(chunked))
    return (
        chunked.join(offsets, "chunk")
        .withColumn(into, F.col("offset") + F.col("chunk_pos"))
        .drop("chunk", "chunk_pos", "offset")
    )


def with_file_position(df: DataFrame, into: str = "position") -> DataFrame:
    """Zero-based row number in the order of sorted files and rows in them.

    For file-backed tables. Needs the rows per file only (read from footers), so
    the rows themselves are not moved.
    """
    located = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    offsets, num_files = file_offsets(df)
    if num_files <= MAX_BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    return located.join(offsets, "_file").withColumn(into, F.col("_offset") + F.col("_row")).drop("_file", "_row", "_offset")


def file_offsets(df: DataFrame) -> tuple[DataFrame, int]:
    """Rows before each file, and the number of files."""
    counts = df.groupBy(F.col("_metadata.file_path").alias("_file")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return offsets, len(df.inputFiles())


def first_n(df: DataFrame, n: int, order_by: str = "id") -> DataFrame:
    """The first `n` rows in the order of one column, nulls first.

    The n-th smallest value is found on that column alone, then the rows up to it are
    kept by a filter, so wide rows are neither sorted nor gathered.
    """
    if n <= 0:
        return df.limit(0)
    positions = with_position(df.select(order_by), [order_by])
    last = positions.where(F.col("position") == n - 1).select(order_by).first()
    if last is None:
        return df
    column, value = F.col(order_by), last[0]
    if value is None:
        return df.where(column.isNull()).limit(n)
    below = df.where(column.isNull() | (column < F.lit(value)))
    return below.unionByName(df.where(column == F.lit(value)).limit(n - below.count()))


def first_n_in_files(df: DataFrame, n: int) -> DataFrame:
    """The first `n` rows as stored: sorted files, rows in their order."""
    return with_file_position(df).where(F.col("position") < n).drop("position")
