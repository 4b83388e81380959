"""Index of the ids that need no further request: a bucketed, sorted table beside the results.

Without it, every run and every stream batch reads the ids of the whole results table and shuffles them. The index is
kept up to date by file: `refresh` reads only results files it does not know yet and appends
their ids, hashed into buckets and sorted. A join on the id then moves the input alone, as
the buckets are the partitions that the join asks for.

The index is a hidden folder of the table, `_ids`, with the bucketed files, the list of indexed files, and
nothing else; the session's catalog names it only while it is open. A stop between both appends leaves ids twice,
which an anti-join does not mind. Compaction gives files new names: they are indexed again.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.sources import files
from inkwell.sources.responses import finished, read_results

FOLDER = "_ids"
LEAST_BUCKETS = 64


class IdIndex:
    """Open with `with`; `refresh` before `done`."""

    def __init__(self, spark: SparkSession, path: str, api_type: str = "chat-completion", buckets: int | None = None) -> None:
        self.spark, self.path, self.api_type = spark, path.rstrip("/"), api_type
        self.root = f"{self.path}/{FOLDER}"
        self.buckets = self._stored_buckets() or buckets or max(
            LEAST_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions"))
        )
        self.name = f"inkwell_ids_{hashlib.md5(self.root.encode()).hexdigest()}"

    def __enter__(self) -> IdIndex:
        self.spark.sql(f"DROP TABLE IF EXISTS `{self.name}`")
        location = self.folder.replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE `{self.name}` (id STRING, answered BOOLEAN) USING parquet LOCATION '{location}' "
            f"CLUSTERED BY (id) SORTED BY (id) INTO {self.buckets} BUCKETS"
        )
        return self

    def __exit__(self, *_) -> None:
        """The table's files stay: it is an external one."""
        self.spark.sql(f"DROP TABLE IF EXISTS `{self.name}`")

    @property
    def folder(self) -> str:
        return f"{self.root}/buckets-{self.buckets}"

    def _stored_buckets(self) -> int | None:
        """The number of buckets that an earlier run chose; it is part of the folder's name and never changes."""
        if not files.exists(self.spark, self.root):
            return None
        found = [name for name in files.list_folders(self.spark, self.root) if name.startswith("buckets-")]
        return int(found[0].removeprefix("buckets-")) if found else None

    def _known(self) -> DataFrame:
        path = f"{self.root}/files"
        if not files.exists(self.spark, path):
            return self.spark.createDataFrame([], "file_path string")
        return self.spark.read.schema("file_path string").parquet(path)

    def refresh(self) -> int:
        """Index results files that are new; returns how many there were."""
        if not files.has_file(self.spark, self.path):
            return 0
        known = {row.file_path for row in self._known().toLocalIterator()}
        new = [name for name, _ in files.list_files(self.spark, self.path) if name not in known]
        if not new:
            return 0
        results = read_results(self.spark, self.path, self.api_type, only=new)
        rows = finished(results).where(F.col("id").isNotNull()).select("id", (F.col("status") == "ok").alias("answered"))
        # one file for each bucket: tasks are the buckets
        dealt = rows.distinct().repartition(self.buckets, "id")
        dealt.write.mode("append").format("parquet").option("compression", "zstd").bucketBy(self.buckets, "id").sortBy(
            "id"
        ).saveAsTable(self.name)
        listed = self.spark.createDataFrame([(name,) for name in new], "file_path string")
        listed.coalesce(1).write.mode("append").parquet(f"{self.root}/files")
        self.spark.catalog.refreshTable(self.name)
        return len(new)

    def done(self, retry_failed: bool = False) -> DataFrame:
        """Ids that need no further request, as they are stored: not shuffled, some maybe twice."""
        rows = self.spark.table(self.name)
        return (rows.where("answered") if retry_failed else rows).select("id")
