"""WARC archives with an index that is written first: place, length, URL and digest per record.

`write_archives` puts one record per row into per-record gzip members and returns the index
(a Parquet table). `read_records` takes any selection of index rows, sorts them by place,
merges neighbouring ranges and reads only those bytes.

Equal payloads are stored once: the record with the largest id is the response, the others
revisit it. Only narrow rows (id and digest) are grouped; the pages are shuffled once, by id.

A task writes a file under a name of its own, and the index is committed by Spark. A task that
is run again writes another file; files of lost attempts are named by no index row.

Defined cases: a null payload counts as empty; a null URL is written without a target and read
back as null; rows with equal id and payload are separate records, of which one is the response
and the others revisit that id; a null id is smaller than all others; an empty table
gives an empty index and no file.
"""

from __future__ import annotations

import base64
import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.session import materialize, scratch_path
from inkwell.sources.shipping import ship_package

BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"

INDEX_SCHEMA = (
    "file string, offset bigint, length bigint, url string, digest string, "
    "record_id bigint, payload_bytes bigint, record_type string, refers_to bigint"
)
RECORD_SCHEMA = (
    "record_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
    "refers_to bigint, payload string"
)
_TYPES = {"string": pa.string(), "bigint": pa.int64()}


def _arrow_schema(text: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (f.split() for f in text.split(", "))])


INDEX_ARROW, RECORD_ARROW = _arrow_schema(INDEX_SCHEMA), _arrow_schema(RECORD_SCHEMA)


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a text's UTF-8 bytes."""
    digits = F.sha1(payload.cast("binary"))
    parts = [
        F.lpad(F.conv(F.substring(digits, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)
    ]
    return F.translate(F.concat(*parts), BASE32_DIGITS, BASE32)


def record_types(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(key, content, type, refers_to) from distinct (id, key, content, digest, bytes).

    Of records with equal payloads the one with the largest (key, content) is the response.
    """
    order = F.struct("key", "content")
    kept = (
        pages.where(F.col("bytes") >= min_bytes)
        .groupBy("digest")
        .agg(F.max(order).alias("kept"), F.max_by("id", order).alias("kept_id"), F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("digest").alias("kept_digest"), "kept", "kept_id")
    )
    revisit = F.col("kept").isNotNull() & (order != F.col("kept")) & (F.col("bytes") >= min_bytes)
    return pages.join(kept, F.col("digest") == F.col("kept_digest"), "left").select(
        "key",
        "content",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("kept_id")).alias("refers_to"),
    )


def _header(fields: list[tuple[str, str]], first: str) -> bytes:
    return (first + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def record_bytes(
    record_id: int | None, url: str | None, digest: str, payload: bytes, record_type: str, refers_to: int | None
) -> bytes:
    """One WARC record. A revisit keeps the response's HTTP header and leaves the payload out."""
    http = _header(
        [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], "HTTP/1.1 200 OK"
    )
    block = http if record_type == "revisit" else http + payload
    fields = [("WARC-Type", record_type), ("WARC-Record-ID", f"<urn:page:{'' if record_id is None else record_id}>")]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    fields += [("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if record_type == "revisit":
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        fields.append(("WARC-Refers-To", f"<urn:page:{'' if refers_to is None else refers_to}>"))
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _header(fields, "WARC/1.1") + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 3) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse_record(data: bytes) -> tuple:
    """(record_id, url, payload_bytes, digest, type, refers_to, payload) of one record's bytes."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    http_fields = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    size = int(http_fields["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response":
        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")

    def number(urn: str | None) -> int | None:
        return int(urn[len("<urn:page:") : -1]) if urn and urn != "<urn:page:>" else None

    return (
        number(fields["WARC-Record-ID"]),
        fields.get("WARC-Target-URI"),
        size,
        digest,
        kind,
        number(fields.get("WARC-Refers-To")),
        payload.decode("utf-8", "surrogatepass") if kind == "response" else None,
    )


def write_archives(
    pages: DataFrame,
    folder: str,
    record_id: str = "page_id",
    url: str = "url",
    payload: str = "html",
    min_bytes: int = 0,
    max_file_bytes: int = 1 << 30,
) -> DataFrame:
    """Write one record per row below `folder`; returns the stored index of all records."""
    ship_package(pages.sparkSession)
    keyed = pages.select(
        pages[record_id].cast("bigint").alias("id"),
        pages[url].alias("url"),
        F.coalesce(pages[payload], F.lit("")).alias("payload"),
    ).select(
        "*",
        F.coalesce("id", F.lit(-(2**63))).alias("key"),
        F.xxhash64("url", "payload").alias("content"),
    )
    # Narrow rows decide; rows equal in id, URL and payload are one row here.
    narrow = keyed.select(
        "id",
        "key",
        "content",
        sha1_base32(F.col("payload")).alias("digest"),
        F.octet_length("payload").cast("bigint").alias("bytes"),
    ).distinct()
    types = record_types(narrow, min_bytes).select(
        F.col("key").alias("t_key"), F.col("content").alias("t_content"), "record_type", "refers_to"
    )
    joined = keyed.join(types, (F.col("key") == F.col("t_key")) & (F.col("content") == F.col("t_content")))
    copy = F.row_number().over(Window.partitionBy("key", "content").orderBy("url"))
    again = (copy > 1) & (F.octet_length("payload") >= min_bytes) & (F.col("record_type") == "response")
    records = joined.select(
        "id",
        "url",
        F.col("payload").cast("binary").alias("payload"),
        F.when(again, "revisit").otherwise(F.col("record_type")).alias("record_type"),
        F.when(again, F.col("id")).otherwise(F.col("refers_to")).alias("refers_to"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = arrow_fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, path, size = None, None, 0
        try:
            for batch in batches:
                index = []
                for number, target, body, kind, refers in zip(
                    *[batch.column(i).to_pylist() for i in range(5)], strict=True
                ):
                    if out is None or size >= max_file_bytes:
                        if out is not None:
                            out.close()
                        path, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(path, compression=None)
                    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
                    member = gzip_member(record_bytes(number, target, digest, body, kind, refers))
                    out.write(member)
                    name = path.rsplit("/", 1)[1]
                    index.append((name, size, len(member), target, digest, number, len(body), kind, refers))
                    size += len(member)
                columns = list(zip(*index, strict=True)) or [()] * len(INDEX_ARROW)
                yield pa.record_batch(
                    [pa.array(list(c), type=t.type) for c, t in zip(columns, INDEX_ARROW, strict=True)],
                    schema=INDEX_ARROW,
                )
        finally:
            if out is not None:
                out.close()

    return materialize(records.mapInArrow(write, INDEX_SCHEMA), "warc-index")


def _ranges(rows: list[tuple[int, int]], gap: int, most: int) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Merge (offset, length) rows in order into reads of at most `most` bytes."""
    start = end = None
    inside: list[tuple[int, int]] = []
    for offset, length in rows:
        if start is not None and offset <= end + gap and max(end, offset + length) - start <= most:
            end = max(end, offset + length)
            inside.append((offset, length))
            continue
        if start is not None:
            yield start, end, inside
        start, end, inside = offset, offset + length, [(offset, length)]
    if start is not None:
        yield start, end, inside


def read_records(
    index: DataFrame, folder: str, gap: int = 1 << 16, most: int = 1 << 23, span: int = 1 << 24, payload: bool = True
) -> DataFrame:
    """The records that the index rows name, read as merged byte ranges.

    A task reads whole spans of `span` bytes of a file, so a large archive is read by many tasks.
    Every response's payload is held against its digest. `payload=False` leaves the text out.
    """
    ship_package(index.sparkSession)
    unit = F.floor(F.col("offset") / span)
    placed = index.select("file", "offset", "length", unit.alias("span"))
    # by the bytes to read, which the size of the index does not tell
    tasks = max(1, math.ceil((index.agg(F.sum("length")).first()[0] or 0) / span))
    placed = placed.repartition(tasks, "file", "span").sortWithinPartitions("file", "offset").drop("span")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = arrow_fs.FileSystem.from_uri(folder)
        for batch in batches:
            files, offsets, lengths = (batch.column(i).to_pylist() for i in range(3))
            i = 0
            while i < len(files):
                j = i
                while j < len(files) and files[j] == files[i]:
                    j += 1
                with store.open_input_file(f"{root}/{files[i]}") as source:
                    rows = list(zip(offsets[i:j], lengths[i:j], strict=True))
                    for start, end, inside in _ranges(rows, gap, most):
                        data = source.read_at(end - start, start)
                        records = [
                            parse_record(zlib.decompress(data[o - start : o - start + n], 31)) for o, n in inside
                        ]
                        columns = list(zip(*records, strict=True))
                        if not payload:
                            columns[6] = [None] * len(records)
                        yield pa.record_batch(
                            [pa.array(list(c), type=t.type) for c, t in zip(columns, RECORD_ARROW, strict=True)],
                            schema=RECORD_ARROW,
                        )
                i = j

    return placed.mapInArrow(read, RECORD_SCHEMA)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write `pages` (page_id, url, html) as archives in the shared folder and read every record back."""
    spark = pages.sparkSession
    folder = as_uri(scratch_path(spark, "warc"))
    index = write_archives(pages, folder, min_bytes=min_bytes)
    return read_records(index, folder, payload=False)


def as_uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"
