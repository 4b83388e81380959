"""Arrow files as saved by dataset tools (`save_to_disk` folders), in stream or file format.

A Python data source: a partition is a range of bytes of a file, and its task reads the record batches that begin in the
range. It finds them by the headers of the messages before, so planning opens no file, and one large file is
read by many tasks. Columns are pruned by the schema that the load asks for; simple filters are
applied to whole batches before rows leave the task. In a store that Arrow cannot open, Spark's own
reader brings the files, one task for each.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from inkwell.sources.shared_files import direct, open_store
from inkwell.sources.shipping import ship_package

# Fixed values of the Arrow format: the mark of its file format and of a message, and message types.
MAGIC, MESSAGE = b"ARROW1", 0xFFFFFFFF
DICTIONARY, RECORDS = 2, 3

PARTITION_BYTES = "spark.sql.files.maxPartitionBytes"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def open_file(path: str) -> pa.NativeFile:
    store, inner = open_store(path)
    if store.type_name == "local":
        return pa.memory_map(inner)  # columns that are not asked for are never read
    return store.open_input_file(inner)


def message_at(source: pa.NativeFile, at: int) -> tuple[int, int] | None:
    """Type and end of the message at a place; None behind the last one."""
    source.seek(at)
    mark, size = struct.unpack("<II", source.read(8).ljust(8, b"\0"))
    head = 8
    if mark != MESSAGE:  # written before the mark was introduced
        size, head = mark, 4
    if size == 0:
        return None
    source.seek(at + head)
    table = source.read(size)
    root = struct.unpack_from("<I", table, 0)[0]
    fields = root - struct.unpack_from("<i", table, root)[0]

    def place(number: int) -> int:
        inside = struct.unpack_from("<H", table, fields)[0] > 4 + 2 * number
        return struct.unpack_from("<H", table, fields + 4 + 2 * number)[0] if inside else 0

    kind = table[root + place(1)] if place(1) else 0
    body = struct.unpack_from("<q", table, root + place(3))[0] if place(3) else 0
    return kind, at + head + size + body


def batches_between(source: pa.NativeFile, start: int, end: int) -> Iterator[pa.RecordBatch]:
    """Record batches that begin in a range of bytes. Files with dictionaries are read from the range that holds their start."""
    source.seek(0)
    at = 8 if source.read(6) == MAGIC else 0
    source.seek(at)
    schema = pa.ipc.read_schema(source)
    at = message_at(source, at)[1]
    while (found := message_at(source, at)) is not None:
        kind, after = found
        if kind == DICTIONARY:
            if start == 0:
                yield from whole_file(source)
            return
        if at >= end:
            return
        if kind == RECORDS and at >= start:
            source.seek(at)
            yield pa.ipc.read_record_batch(pa.ipc.read_message(source), schema)
        at = after


def whole_file(source) -> Iterator[pa.RecordBatch]:
    source.seek(0)
    if source.read(6) == MAGIC:
        reader = pa.ipc.open_file(source)
        for i in range(reader.num_record_batches):
            yield reader.get_batch(i)
    else:
        source.seek(0)
        yield from pa.ipc.open_stream(source)


def file_schema(source) -> pa.Schema:
    source.seek(0)
    is_file = source.read(6) == MAGIC
    source.seek(0)
    return (pa.ipc.open_file if is_file else pa.ipc.open_stream)(source).schema


def as_asked(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """The asked columns in their types; a column that a file does not have is null."""
    columns = []
    for field in schema:
        at = batch.schema.get_field_index(field.name)
        column = pa.nulls(batch.num_rows, field.type) if at < 0 else batch.column(at)
        if pa.types.is_dictionary(column.type):
            column = column.dictionary_decode()
        columns.append(column if column.type == field.type else column.cast(field.type))
    return pa.record_batch(columns, schema=schema)


@dataclass(frozen=True)
class Range(ds.InputPartition):
    path: str
    start: int
    end: int


class ArrowFiles(ds.DataSource):
    """Arrow files listed in the option `files`, a JSON list of (path, bytes)."""

    @classmethod
    def name(cls) -> str:
        return "inkwell_arrow"

    def reader(self, schema: StructType) -> ds.DataSourceReader:
        listed = json.loads(self.options["files"])
        return _Reader(listed, int(self.options["partition_bytes"]), to_arrow_schema(schema))


class _Reader(ds.DataSourceReader):
    def __init__(self, listed: list[tuple[str, int]], partition_bytes: int, schema: pa.Schema) -> None:
        self.listed, self.partition_bytes, self.schema = listed, partition_bytes, schema
        self.filters: list[ds.Filter] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for one in filters:
            if _can_apply(one, self.schema):
                self.filters.append(one)
            else:
                yield one

    def partitions(self) -> Sequence[ds.InputPartition]:
        step = max(1, self.partition_bytes)
        return [
            Range(path, start, size if start + step >= size else start + step)
            for path, size in self.listed
            for start in range(0, max(1, size), step)
        ] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        with open_file(partition.path) as source:
            for batch in batches_between(source, partition.start, partition.end):
                yield filtered(as_asked(batch, self.schema), self.filters)


_COMPARISONS = {
    ds.EqualTo: pc.equal,
    ds.GreaterThan: pc.greater,
    ds.GreaterThanOrEqual: pc.greater_equal,
    ds.LessThan: pc.less,
    ds.LessThanOrEqual: pc.less_equal,
}
_STRINGS = {ds.StringStartsWith: pc.starts_with, ds.StringEndsWith: pc.ends_with, ds.StringContains: pc.match_substring}


def _can_apply(one: ds.Filter, schema: pa.Schema) -> bool:
    """Filters that mean the same to Arrow: top-level columns of whole numbers, texts, truth values and dates."""
    if isinstance(one, ds.Not):
        return _can_apply(one.child, schema)
    if len(one.attribute) != 1 or schema.get_field_index(one.attribute[0]) < 0:
        return False
    kind = schema.field(one.attribute[0]).type
    if isinstance(one, (ds.IsNull, ds.IsNotNull)):
        return True
    same = pa.types.is_integer(kind) or pa.types.is_string(kind) or pa.types.is_boolean(kind) or pa.types.is_date(kind)
    if isinstance(one, ds.In):
        return same and all(v is not None for v in one.value)
    return same and (type(one) in _COMPARISONS or type(one) in _STRINGS and pa.types.is_string(kind))


def _mask(batch: pa.RecordBatch, one: ds.Filter) -> pa.Array:
    if isinstance(one, ds.Not):
        return pc.invert(_mask(batch, one.child))
    column = batch.column(batch.schema.get_field_index(one.attribute[0]))
    if isinstance(one, ds.IsNull):
        return pc.is_null(column)
    if isinstance(one, ds.IsNotNull):
        return pc.is_valid(column)
    if isinstance(one, ds.In):
        found = pc.is_in(column, pa.array(one.value, type=column.type))
        return pc.if_else(pc.is_valid(column), found, pa.scalar(None, pa.bool_()))
    if type(one) in _STRINGS:
        return _STRINGS[type(one)](column, one.value)
    return _COMPARISONS[type(one)](column, pa.scalar(one.value, type=column.type))


def filtered(batch: pa.RecordBatch, filters: list[ds.Filter]) -> pa.RecordBatch:
    """Rows for which all filters are true; a null is not."""
    for one in filters:
        batch = batch.filter(_mask(batch, one))
    return batch


def read_arrow_files(
    spark: SparkSession,
    listed: list[tuple[str, int]],
    columns: list[str] | None = None,
    where: Column | str | None = None,
) -> DataFrame:
    """A table of listed (path, bytes); only the first file's schema is read on the driver.

    With `columns`, those and the ones that `where` names are taken out of the batches, no others.
    """
    ship_package(spark)
    folders = {path.rsplit("/", 1)[0] for path, _ in listed}
    known = {folder: direct(spark, folder) for folder in folders}
    if any(store is None for store in known.values()):
        df = _by_spark(spark, [path for path, _ in listed])
        df = df if where is None else df.where(where)
        return df.select(*columns) if columns else df
    placed = [(f"{known[path.rsplit('/', 1)[0]]}/{path.rsplit('/', 1)[1]}", size) for path, size in listed]
    with open_file(placed[0][0]) as source:
        schema = from_arrow_schema(file_schema(source))
    if columns:
        needed = {*columns, *_named_by(spark, schema, where)}
        schema = StructType([f for f in schema if f.name in needed])
    spark.dataSource.register(ArrowFiles)
    spark.conf.set(PUSHDOWN, "true")
    reader = spark.read.format(ArrowFiles.name()).schema(schema).option("files", json.dumps(placed))
    df = reader.option("partition_bytes", _partition_bytes(spark)).load()
    df = df if where is None else df.where(where)
    return df.select(*columns) if columns else df


def _named_by(spark: SparkSession, schema: StructType, where: Column | str | None) -> set[str]:
    """Columns that a condition reads, by its analysed form."""
    if where is None:
        return set()
    plan = spark.createDataFrame([], schema).where(where)._jdf.queryExecution().analyzed()
    found = plan.condition().references().toSeq()
    return {found.apply(i).name() for i in range(found.size())}


def _partition_bytes(spark: SparkSession) -> int:
    text = spark.conf.get(PARTITION_BYTES, "128m")
    return int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(text))


def _by_spark(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The same files brought by Spark's reader: one task and one whole file in memory at a time."""
    found = spark.read.format("binaryFile").load(paths).select("content")

    def schema_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                text = file_schema(pa.BufferReader(content.as_buffer())).serialize().to_pybytes()
                yield pa.record_batch([pa.array([text], type=pa.binary())], names=["schema"])

    first = spark.read.format("binaryFile").load(paths[0]).select("content").mapInArrow(schema_of, "schema binary").first()
    schema = from_arrow_schema(pa.ipc.read_schema(pa.py_buffer(bytes(first["schema"]))))
    asked = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for one in whole_file(pa.BufferReader(content.as_buffer())):
                    yield as_asked(one, asked)

    return found.mapInArrow(read, schema)

