"""Input tables: loading, splits, description."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.config import DATASET_FORMATS, RunConfig
from inkwell.sources import files

# File name endings by format, to look only at data files in mixed folders
# (a half-written `.incomplete` file is not hidden from Spark otherwise).
_ENDINGS = {"parquet": "*.parquet", "orc": "*.orc", "arrow": "*.arrow"}

# Loader options of other tools that name no Spark option.
_NOT_SPARK_OPTIONS = ("name", "cache_dir", "streaming", "keep_in_memory", "batch_size", "batch_readahead",
                      "fragment_readahead", "columns", "filter", "where", "split", "glob_pattern")


class NoDatasetFilesError(FileNotFoundError):
    """The input path holds no data files."""


class AmbiguousSplitError(ValueError):
    """The input path holds several splits and none was chosen."""


def resolve_split(spark: SparkSession, path: str, split: str | None, pattern: str = "*") -> str:
    """The folder to read. Several split folders and no `split` is an error.

    Folders named `key=value` are partitions of one table, not splits.
    """
    if split is not None:
        chosen = f"{path.rstrip('/')}/{split}"
        if not files.exists(spark, chosen):
            raise ValueError(f"split {split!r} not found in {path}, have {files.list_folders(spark, path)}")
        return chosen
    folders = [name for name in files.list_folders(spark, path) if "=" not in name]
    if len(folders) > 1 and not files.has_file(spark, path, pattern, recursive=False):
        raise AmbiguousSplitError(f"{path} has splits {folders}, choose one with split=...")
    return path


def load_input(
    spark: SparkSession,
    fmt: str,
    path: str,
    split: str | None = None,
    columns: list[str] | None = None,
    where: Column | str | None = None,
    check_splits: bool = True,
    **options: Any,
) -> DataFrame:
    """Load a table; the column list and the filter reach the file scan.

    Parquet folders are read recursively, only `*.parquet` files. `schema`, a DDL
    string, is taken as an option too and spares the inference pass.
    """
    fmt = DATASET_FORMATS.get(fmt, fmt)
    pattern = options.pop("glob_pattern", None)
    pattern = pattern.rsplit("/", 1)[-1] if pattern else _ENDINGS.get(fmt, "*")
    if check_splits or split is not None:
        path = resolve_split(spark, path, split, pattern)
    if not files.has_file(spark, path, pattern):
        raise NoDatasetFilesError(f"no files in {path} match {pattern}")
    if fmt == "arrow":
        from inkwell.sources.arrow_files import read_arrow_files

        return read_arrow_files(spark, files.list_files(spark, path, pattern), columns, where)
    else:
        reader = spark.read.format(fmt)
        if "schema" in options:
            reader = reader.schema(options.pop("schema"))
        if any("=" in name for name in files.list_folders(spark, path)):
            reader = reader.option("pathGlobFilter", pattern)
        else:
            reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
        df = reader.options(**options).load(path)
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def load_configured(spark: SparkSession, config: RunConfig) -> DataFrame:
    """The input a run config names."""
    kwargs = dict(config.dataset_kwargs)
    split = kwargs.get("split")
    name = kwargs.get("name")
    path = f"{config.dataset_path.rstrip('/')}/{name}" if name else config.dataset_path
    options = {key: value for key, value in kwargs.items() if key not in _NOT_SPARK_OPTIONS}
    if "glob_pattern" in kwargs:
        options["glob_pattern"] = kwargs["glob_pattern"]
    if kwargs.get("streaming"):
        raise ValueError("streamed datasets are not supported here, see inkwell.streaming")
    return load_input(
        spark,
        config.dataset_type,
        path,
        split=split,
        columns=kwargs.get("columns"),
        where=kwargs.get("filter") or kwargs.get("where"),
        # Only datasets with named splits can be ambiguous; a plain parquet
        # folder is read whole, sub-folders included.
        check_splits=config.dataset_type != "parquet",
        **options,
    )


def describe_input(df: DataFrame) -> DataFrame:
    """One row: rows, files, bytes, columns and schema text of a file-backed table.

    Files are counted per file first, so the count needs footers only.
    """
    per_file = df.groupBy(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("file_size")
    ).agg(F.count(F.lit(1)).alias("n"))
    return per_file.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("num_rows"),
        F.count(F.lit(1)).alias("num_files"),
        F.coalesce(F.sum("file_size"), F.lit(0)).cast("bigint").alias("num_bytes"),
    ).select(
        "*",
        F.lit(len(df.columns)).alias("num_columns"),
        F.lit(df.schema.simpleString()).alias("schema"),
    )


def has_row_index(df: DataFrame) -> bool:
    """Whether rows still know their file and row number (`_metadata` of a parquet table)."""
    # Asked of the analysed plan: selecting a column that is not there would be
    # logged as an error.
    hidden = df._jdf.queryExecution().analyzed().metadataOutput()
    columns = [hidden.apply(i) for i in range(hidden.size())]
    return any(c.name() == "_metadata" and "row_index" in c.dataType().catalogString() for c in columns)
