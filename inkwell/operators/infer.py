"""The request map: rows with a request body in, one results row per attempt out."""

from __future__ import annotations

import json
import re
import threading
import uuid
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.config import RunConfig
from inkwell.functions.errors import BREAKER_CLASSES, classify
from inkwell.functions.requests import request_body
from inkwell.functions.sharding import hash_shard
from inkwell.operators.client import Client, DeadlineExceeded
from inkwell.schemas import ATTEMPTS, one_line, response_ddl
from inkwell.sources.shipping import ship_package

ClientFactory = Callable[[str], Client]

ATTEMPT_ARROW = pa.schema(
    [
        ("id", pa.string()),
        ("shard", pa.int32()),
        ("status", pa.string()),
        ("error_class", pa.string()),
        ("error_text", pa.string()),
        ("http_status", pa.int32()),
        ("started_at", pa.timestamp("us", tz="UTC")),
        ("finished_at", pa.timestamp("us", tz="UTC")),
        ("body", pa.string()),
    ]
)
_COLUMNS = ATTEMPT_ARROW.names


class Breaker:
    """Counts failures in a row; trips for good at `max_failures`."""

    def __init__(self, max_failures: int) -> None:
        self.max_failures = max_failures
        self.streak = 0
        self.tripped = False

    def record(self, status: str, error_class: str | None) -> None:
        if status == "ok":
            self.streak = 0
        elif error_class in BREAKER_CLASSES:
            self.streak += 1
            self.tripped = self.tripped or self.streak >= self.max_failures


def row_hash(df: DataFrame) -> Column:
    """A hash over all columns of a row that can be hashed."""
    names = [f.name for f in df.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    return F.xxhash64(*[F.col(f"`{name}`") for name in names])


def align(df: DataFrame, config: RunConfig, row_key: Column | None = None) -> DataFrame:
    """Exactly `tasks_per_shard` partitions for each shard, rows spread by `row_key`.

    Adds the shard if there is none. The partition number is computed, not
    hashed, so no partition holds two shards and none is left empty by a
    collision: a task talks to one endpoint and writes one shard folder.

    The default key is the id with the input, or the whole row where the input is
    not built yet. Copies of one row are told apart only by a key that differs,
    such as their place in a file.
    """
    if row_key is None:
        own = [config.id_column_name, config.input_column_name]
        row_key = row_hash(df.select(*own)) if set(own) <= set(df.columns) else row_hash(df)
    if "shard" not in df.columns:
        df = df.withColumn("shard", _own_shard(config))
    slot = F.pmod(F.xxhash64(row_key), F.lit(config.tasks_per_shard)).cast("int")
    target = F.col("shard") * config.tasks_per_shard + slot
    return df.repartitionById(config.num_shards * config.tasks_per_shard, target)


def _own_shard(config: RunConfig) -> Column:
    """The hash shard; a row without an id goes to the first one, to come out as an error."""
    return F.coalesce(hash_shard(config.id_column_name, config.num_shards), F.lit(0))


def infer(
    df: DataFrame,
    config: RunConfig,
    client_factory: ClientFactory,
    run_id: str | None = None,
    wave: int = 0,
    row_key: Column | None = None,
    aligned: bool = False,
) -> DataFrame:
    """Send one request per row; the result has the results schema.

    `df` needs the id and input columns; a `shard` column is used if there is
    one. Each use of the returned frame sends the requests again: write it once
    and read the table.

    `aligned` says that `align` was called on the source rows, before the prompts
    were built: then only source columns are shuffled, not whole prompts.
    """
    ship_package(df.sparkSession)
    if not aligned:
        df = align(df, config, row_key)
    elif "shard" not in df.columns:
        df = df.withColumn("shard", _own_shard(config))
    request = request_body(config.api_type, config.model, config.input_column_name, config.completions_kwargs)
    rows = df.select(
        F.col(config.id_column_name).cast("string").alias("id"),
        F.col("shard").cast("int").alias("shard"),
        request.alias("request"),
    )
    send = _Sender(
        endpoints=config.endpoints or [""],
        client_factory=client_factory,
        in_flight=config.connections_per_task,
        deadline_s=config.request_timeout_seconds,
        max_failures=config.max_consecutive_failures,
    )
    attempts = rows.mapInArrow(send, one_line(ATTEMPTS))
    return typed_results(attempts, config.api_type, run_id or uuid.uuid4().hex, wave)


def typed_results(attempts: DataFrame, api_type: str, run_id: str, wave: int) -> DataFrame:
    """Parse response bodies into the fixed response struct.

    from_json keeps the declared fields only, at every level, and fills missing
    ones with null.
    """
    return attempts.select(
        "id",
        F.lit(run_id).alias("run_id"),
        F.lit(wave).cast("int").alias("wave"),
        "status",
        "error_class",
        "error_text",
        "http_status",
        "started_at",
        "finished_at",
        F.from_json("body", response_ddl(api_type)).alias("response"),
        "shard",
    )


class _Sender:
    """The function a request task runs over its Arrow batches."""

    def __init__(
        self,
        endpoints: list[str],
        client_factory: ClientFactory,
        in_flight: int,
        deadline_s: float,
        max_failures: int,
        batch_rows: int = 256,
    ) -> None:
        self.endpoints, self.client_factory = endpoints, client_factory
        self.in_flight, self.deadline_s = in_flight, deadline_s
        self.max_failures, self.batch_rows = max_failures, batch_rows

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """At most `in_flight` requests are open, also across input batches.

        Never raises for an endpoint error: a task retry would send the whole
        partition again. After the breaker trips, open requests are left to
        finish and the rest of the rows come out as `aborted`.
        """
        clients: dict[int, Client] = {}
        desk = _Desk(self.in_flight, self.deadline_s)
        with ThreadPoolExecutor(max_workers=self.in_flight) as pool:
            try:
                for _ in range(self.in_flight):
                    pool.submit(desk.work)
                for batch in batches:
                    ids, shards, requests = (batch.column(i).to_pylist() for i in range(3))
                    for shard in set(shards) - clients.keys():
                        clients[shard] = self.client_factory(self.endpoints[shard % len(self.endpoints)])
                        desk.breakers[shard] = Breaker(self.max_failures)
                    desk.lay(zip(ids, shards, map(clients.get, shards), requests, strict=True))
                    while out := desk.collect(self.batch_rows):
                        yield _batch(out)
                while out := desk.collect(self.batch_rows, last=True):
                    yield _batch(out)
            finally:
                desk.close()


class _Desk:
    """Rows that wait for a thread and rows that are answered; the threads take the next row themselves.

    The main thread wakes once for a batch, not for every row.
    """

    def __init__(self, in_flight: int, deadline_s: float) -> None:
        self.in_flight, self.deadline_s = in_flight, deadline_s
        self.breakers: dict[int, Breaker] = {}
        self.waiting: deque = deque()
        self.answered: list[dict[str, Any]] = []
        self.open = 0
        self.closed = False
        self.broken: BaseException | None = None
        lock = threading.Lock()
        self.rows, self.few = threading.Condition(lock), threading.Condition(lock)

    def lay(self, rows: Iterable[tuple]) -> None:
        with self.rows:
            self.waiting.extend(rows)
            self.rows.notify_all()

    def collect(self, most: int, last: bool = False) -> list[dict[str, Any]]:
        """Up to `most` answered rows; none when the threads need more rows, or after the `last`, have answered all."""
        with self.few:
            while not self.broken:
                if len(self.answered) >= most:
                    break
                if not last and len(self.waiting) < self.in_flight:
                    return []
                if last and not self.waiting and not self.open:
                    break
                self.few.wait()
            if self.broken:
                raise self.broken
            out, self.answered = self.answered[:most], self.answered[most:]
            return out

    def close(self) -> None:
        with self.rows:
            self.closed = True
            self.rows.notify_all()

    def work(self) -> None:
        """What each thread does until the desk is closed."""
        try:
            while True:
                with self.rows:
                    while not self.waiting and not self.closed:
                        self.rows.wait()
                    if self.closed:
                        return
                    row_id, shard, client, request = self.waiting.popleft()
                    send = row_id is not None and not self.breakers[shard].tripped
                    self.open += send
                    if not send:
                        self._put(_no_id(shard) if row_id is None else _aborted(row_id, shard))
                if send:
                    row = _send(client, row_id, shard, request, self.deadline_s)
                    with self.rows:
                        self.breakers[shard].record(row["status"], row["error_class"])
                        self.open -= 1
                        self._put(row)
        except BaseException as error:
            with self.rows:
                self.broken = error
                self.few.notify()

    def _put(self, row: dict[str, Any]) -> None:
        self.answered.append(row)
        if len(self.waiting) < self.in_flight:
            self.few.notify()


def _batch(rows: list[dict[str, Any]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({name: [row[name] for row in rows] for name in _COLUMNS}, schema=ATTEMPT_ARROW)


def _row(
    row_id, shard, status, started, finished, error_class=None, error_text=None, body=None, http_status=None
) -> dict[str, Any]:
    return dict(zip(_COLUMNS, (row_id, shard, status, error_class, error_text, http_status, started, finished, body)))


def _aborted(row_id: str, shard: int) -> dict[str, Any]:
    now = datetime.now(timezone.utc)
    return _row(row_id, shard, "aborted", now, now, error_text="not sent: too many consecutive failures")


def _no_id(shard: int) -> dict[str, Any]:
    now = datetime.now(timezone.utc)
    return _row(None, shard, "error", now, now, "other", "not sent: the row has no id")


def http_status_of(error: Exception, text: str) -> int | None:
    """The HTTP status of a failed request, as the client says it or at the start of its message."""
    status = getattr(error, "status", None)
    if isinstance(status, int):
        return status
    found = re.match(r"(?:Error code: )?(\d{3})\b", text)
    return int(found[1]) if found else None


def _send(client: Client, row_id, shard, request, deadline_s: float) -> dict[str, Any]:
    started = datetime.now(timezone.utc)
    try:
        if request is None:
            raise ValueError("the row has no input")
        body = normalise(client.call(request, deadline_s))
        return _row(row_id, shard, "ok", started, datetime.now(timezone.utc), body=body)
    except Exception as error:  # noqa: BLE001 - every failure becomes a row
        text = str(error) or type(error).__name__
        kind = classify(text, isinstance(error, DeadlineExceeded))
        return _row(
            row_id, shard, "error", started, datetime.now(timezone.utc), kind, text, http_status=http_status_of(error, text)
        )


def normalise(body: str) -> str:
    """Check that a body is a response object, and give chat log probabilities the declared shape.

    Endpoints send {"content": [...], "refusal": [...]}; the table holds a list
    of {content, refusal} entries.
    """
    response = json.loads(body)
    if not isinstance(response, dict) or not isinstance(response.get("choices"), list):
        raise ValueError(f"not a response object: {body}")
    changed = False
    for choice in response["choices"]:
        logprobs = choice.get("logprobs") if isinstance(choice, dict) else None
        if isinstance(logprobs, dict) and ("content" in logprobs or "refusal" in logprobs):
            content, refusal = logprobs.get("content") or [], logprobs.get("refusal") or []
            choice["logprobs"] = [
                {
                    "content": content[i] if i < len(content) else None,
                    "refusal": refusal[i] if i < len(refusal) else None,
                }
                for i in range(max(len(content), len(refusal)))
            ]
            changed = True
    return json.dumps(response) if changed else body
