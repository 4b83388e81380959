"""A file sink that keeps what finished tasks wrote, also when the job fails.

Spark's own commit is all or nothing: a job that fails in its last task deletes the files of the others. For answers
that were paid for, that is the wrong way round. Here every task writes its files into a hidden folder
of the table and names them in its commit message. At the commit all named files are moved into the table. At an abort
the files of the tasks that had finished are moved too, and the caller's next run sends the rest only.

A task that is repeated writes files of new names; only those of the attempt that reported are moved. Files of
the others go with the hidden folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

from inkwell.sources.shared_files import direct, open_store
from inkwell.sources.shipping import ship_package

ENDINGS = {"parquet": "parquet", "arrow": "arrow"}
MOVES_AT_ONCE = 32
# Row groups of parquet files: batches are small, and a writer keeps the description of every group until it closes.
GROUP_ROWS, GROUP_BYTES = 16_384, 32 << 20


@dataclass
class Written(ds.WriterCommitMessage):
    """Files of one task, relative to the hidden folder, and their rows."""

    files: list[str] = field(default_factory=list)
    rows: int = 0


class TaskFiles(ds.DataSource):
    """Options: `table` and `hidden`, resolved folders; `kind`; `by`, a column that becomes folders; `max_rows` of a file."""

    @classmethod
    def name(cls) -> str:
        return "inkwell_task_files"

    def writer(self, schema: StructType, overwrite: bool) -> ds.DataSourceWriter:
        if overwrite:
            raise ValueError("this sink appends; choose a new folder instead of overwriting one")
        options = self.options
        return TaskFilesWriter(
            options["table"], options["hidden"], options["kind"], options.get("by"), int(options.get("max_rows", 0))
        )


class TaskFilesWriter(ds.DataSourceArrowWriter):
    def __init__(self, table: str, hidden: str, kind: str, by: str | None, max_rows: int) -> None:
        self.table, self.hidden, self.kind, self.by, self.max_rows = table, hidden, kind, by, max_rows

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Runs in a task: one open file for each folder."""
        store, hidden = open_store(self.hidden)
        context = TaskContext.get()
        stem = f"part-{context.partitionId():05d}-{uuid.uuid4().hex[:12]}"
        message, files = Written(), _OpenFiles(store, hidden, stem, self.kind, self.max_rows)
        try:
            for batch in iterator:
                for folder, rows in self._by_folder(batch):
                    files.append(folder, rows)
                    message.rows += rows.num_rows
        finally:
            files.close()
        message.files = files.names
        return message

    def _by_folder(self, batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
        if not batch.num_rows:
            return
        if not self.by:
            yield "", batch
            return
        at = batch.schema.get_field_index(self.by)
        values = batch.column(at)
        rest = batch.select([n for n in batch.schema.names if n != self.by])
        for value in pc.unique(values).to_pylist():
            mask = pc.is_null(values) if value is None else pc.fill_null(pc.equal(values, value), False)
            name = "__HIVE_DEFAULT_PARTITION__" if value is None else str(value)
            yield f"{self.by}={name}", rest.filter(mask)

    def commit(self, messages: list[Written | None]) -> None:
        self._publish(messages)

    def abort(self, messages: list[Written | None]) -> None:
        self._publish(messages)

    def _publish(self, messages: list[Written | None]) -> None:
        store, hidden = open_store(self.hidden)
        _, table = open_store(self.table)
        named = [name for message in messages if message is not None for name in message.files]
        for folder in {name.rpartition("/")[0] for name in named}:
            store.create_dir(f"{table}/{folder}" if folder else table, recursive=True)
        with ThreadPoolExecutor(MOVES_AT_ONCE) as pool:
            for _ in pool.map(lambda name: store.move(f"{hidden}/{name}", f"{table}/{name}"), named):
                pass
        store.delete_dir(hidden)


@dataclass
class _OpenFile:
    sink: object
    writer: object
    count: int = 0
    waiting: list[pa.RecordBatch] = field(default_factory=list)

    def flush(self) -> None:
        if self.waiting:
            self.writer.write_table(pa.Table.from_batches(self.waiting))
            self.waiting = []


class _OpenFiles:
    """The files that a task has open, one for each folder. Rows of parquet files wait until they fill a row group."""

    def __init__(self, store, hidden: str, stem: str, kind: str, max_rows: int) -> None:
        self.store, self.hidden, self.stem, self.kind, self.max_rows = store, hidden, stem, kind, max_rows
        self.names: list[str] = []
        self.open: dict[str, _OpenFile] = {}

    def append(self, folder: str, rows: pa.RecordBatch) -> None:
        while rows.num_rows:
            if folder not in self.open:
                self.open[folder] = self._start(folder, rows.schema)
            file = self.open[folder]
            some = rows.slice(0, self.max_rows - file.count) if self.max_rows else rows
            file.waiting.append(some)
            if self._full(file):
                file.flush()
            rows = rows.slice(some.num_rows)
            file.count += some.num_rows
            if self.max_rows and file.count >= self.max_rows:
                self._end(folder)

    def _full(self, file: _OpenFile) -> bool:
        if self.kind == "arrow":  # its readers share a file by batches
            return True
        return sum(b.num_rows for b in file.waiting) >= GROUP_ROWS or sum(b.nbytes for b in file.waiting) >= GROUP_BYTES

    def _start(self, folder: str, schema: pa.Schema) -> _OpenFile:
        name = f"{self.stem}-{len(self.names):03d}.{ENDINGS[self.kind]}"
        name = f"{folder}/{name}" if folder else name
        self.store.create_dir(f"{self.hidden}/{name}".rpartition("/")[0], recursive=True)
        sink = self.store.open_output_stream(f"{self.hidden}/{name}")
        self.names.append(name)
        writer = pa.ipc.new_stream(sink, schema) if self.kind == "arrow" else pq.ParquetWriter(sink, schema, compression="zstd")
        return _OpenFile(sink, writer)

    def _end(self, folder: str) -> None:
        file = self.open.pop(folder)
        file.flush()
        file.writer.close()
        file.sink.close()

    def close(self) -> None:
        for folder in list(self.open):
            self._end(folder)


def files_in_progress(table: str) -> dict[str, bool]:
    """Parquet files that tasks write for a resolved table, and whether each is complete."""
    store, inner = open_store(table)
    found = {}
    for info in store.get_file_info(fs.FileSelector(inner, allow_not_found=True, recursive=True)):
        if info.type == fs.FileType.File and "/_writing-" in info.path:
            with store.open_input_file(info.path) as file:
                size = file.size()
                found[info.path] = size > 12 and file.read_at(4, size - 4) == b"PAR1"
    return found


def append_task_files(
    df: DataFrame, path: str, kind: str = "parquet", by: str | None = None, max_rows: int | None = None
) -> bool:
    """Append `df` as it is partitioned. False, with nothing written, where tasks cannot reach the store themselves."""
    spark: SparkSession = df.sparkSession
    table = direct(spark, path)
    if table is None:
        return False
    ship_package(spark)
    spark.dataSource.register(TaskFiles)
    hidden = f"{table.rstrip('/')}/_writing-{uuid.uuid4().hex}"
    store, inner = open_store(hidden)
    store.create_dir(inner, recursive=True)
    writer = df.write.format(TaskFiles.name()).mode("append")
    for key, value in {"table": table, "hidden": hidden, "kind": kind, "by": by, "max_rows": max_rows}.items():
        if value:
            writer = writer.option(key, value)
    writer.save()
    return True
