import json
import threading
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkwell.config import RunConfig
from inkwell.functions.parsing import content, finish_reason, text, usage_columns
from inkwell.operators.client import DeadlineExceeded, RequestFailed, StubClient
from inkwell.operators.infer import ATTEMPT_ARROW, Breaker, _Sender, infer, normalise, typed_results
from inkwell.operators.transforms import apply_named, register, register_rows
from inkwell.schemas import response_ddl, responses_schema, results_schema


def config(**changes):
    values = dict(api_type="completion", model="m", dataset_path="x", output_path="/tmp/x", max_connections=8, num_workers=2,
                  num_inference_servers=2)
    return RunConfig(**{**values, **changes})


def batches(n, shard=0, size=50):
    rows = [{"id": str(i), "shard": shard, "request": json.dumps({"prompt": "x" * i})} for i in range(n)]
    schema = pa.schema([("id", pa.string()), ("shard", pa.int32()), ("request", pa.string())])
    for i in range(0, n, size):
        yield pa.RecordBatch.from_pylist(rows[i : i + size], schema=schema)


def send(client, n=200, in_flight=4, max_failures=20, deadline_s=5.0):
    sender = _Sender(["e"], lambda endpoint: client, in_flight, deadline_s, max_failures)
    out = list(sender(batches(n)))
    assert all(b.schema.equals(ATTEMPT_ARROW) for b in out)
    return [row for batch in out for row in batch.to_pylist()]


class Counting:
    """Counts open calls; may fail on a schedule of call numbers."""

    def __init__(self, outcome=lambda call: None, latency_s=0.0):
        self.outcome, self.latency_s = outcome, latency_s
        self.lock, self.open, self.most, self.calls = threading.Lock(), 0, 0, 0

    def call(self, request, deadline_s):
        with self.lock:
            self.calls += 1
            number = self.calls
            self.open += 1
            self.most = max(self.most, self.open)
        time.sleep(self.latency_s)
        with self.lock:
            self.open -= 1
        error = self.outcome(number)
        if error == "timeout":
            raise DeadlineExceeded("late")
        if error:
            raise RequestFailed(error)
        return StubClient().call(request, deadline_s)


def test_in_flight_is_bounded_and_kept_across_batches():
    client = Counting(latency_s=0.01)
    began = time.time()
    rows = send(client, n=200, in_flight=10)
    assert sorted(int(r["id"]) for r in rows) == list(range(200))
    assert client.most == 10
    assert time.time() - began < 1.5  # about 200 / 10 * 0.01 s


def test_failures_become_rows():
    kinds = {1: "Connection refused", 2: "maximum context length", 3: "timeout", 4: "bad request"}
    rows = send(Counting(lambda call: kinds.get(call % 10)), n=100, in_flight=1)
    errors = [r for r in rows if r["status"] == "error"]
    assert len(rows) == 100 and len(errors) == 40
    assert {r["error_class"] for r in errors} == {"api", "context_length", "timeout", "other"}
    assert all(r["body"] is None and r["finished_at"] >= r["started_at"] for r in errors)


def test_breaker_stops_sending():
    client = Counting(lambda call: "Connection refused" if call > 30 else None)
    rows = send(client, n=100, in_flight=1, max_failures=5)
    by_status = {s: sum(r["status"] == s for r in rows) for s in ("ok", "error", "aborted")}
    assert by_status == {"ok": 30, "error": 5, "aborted": 65}
    assert client.calls == 35


def test_breaker_counts_only_lost_connections_and_timeouts():
    breaker = Breaker(2)
    for status, kind in [("error", "api"), ("error", "other"), ("ok", None), ("error", "timeout"), ("error", "context_length")]:
        breaker.record(status, kind)
    assert breaker.streak == 1 and not breaker.tripped
    breaker.record("error", "api")
    assert breaker.tripped
    breaker.record("ok", None)
    assert breaker.tripped


def test_rows_without_input_are_errors(spark):
    rows = spark.createDataFrame([("a", "p"), ("b", None)], "id string, prompt string")
    got = {r.id: (r.status, r.error_class) for r in infer(rows, config(), StubClient()).collect()}
    assert got == {"a": ("ok", None), "b": ("error", "other")}


def test_each_task_serves_one_shard(spark):
    rows = spark.range(400).select(F.col("id").cast("string").alias("id"), F.lit("p").alias("prompt"))
    results = infer(rows, config(num_inference_servers=4), StubClient())
    assert results.rdd.getNumPartitions() == 8
    tasks = results.groupBy(F.spark_partition_id().alias("task")).agg(F.countDistinct("shard").alias("n"), F.count("*").alias("rows"))
    counts = tasks.collect()
    assert len(counts) == 8 and all(r.n == 1 and r.rows > 0 for r in counts)


def test_copies_of_one_row_are_spread_by_a_row_key(spark):
    rows = spark.range(1000).select(F.lit("same").alias("id"), F.lit("p").alias("prompt"), F.col("id").alias("n"))
    results = infer(rows, config(num_inference_servers=1, num_workers=4), StubClient(), row_key=F.col("n"))
    sizes = [r["count"] for r in results.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 400


def test_results_have_the_declared_schema(spark):
    rows = spark.createDataFrame([("a", "p")], "id string, prompt string")
    for api_type in ("completion", "chat-completion"):
        frame = rows.withColumn("prompt", F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")))) if api_type == "chat-completion" else rows
        results = infer(frame, config(api_type=api_type), StubClient(), run_id="r")
        assert [(f.name, f.dataType) for f in results.schema] == [(f.name, f.dataType) for f in results_schema(api_type)]


CHAT_BODY = {
    "id": "chatcmpl-1",
    "choices": [
        {
            "finish_reason": "stop",
            "index": 0,
            "logprobs": {
                "content": [
                    {"token": "a", "bytes": [97], "logprob": -0.5, "top_logprobs": [{"token": "b", "bytes": None, "logprob": -1.5}]},
                    {"token": "c", "bytes": None, "logprob": -0.25, "top_logprobs": []},
                ],
                "refusal": None,
            },
            "message": {
                "content": "hi",
                "role": "assistant",
                "reasoning_content": "extra",
                "tool_calls": [{"id": "t", "type": "function", "function": {"name": "f", "arguments": "{}", "extra": 1}}],
                "annotations": [{"type": "url_citation", "url_citation": {"start_index": 1, "end_index": 2, "title": "t", "url": "u"}}],
            },
        },
        {"finish_reason": "length", "index": 1, "logprobs": None, "message": {"content": "ho", "role": "assistant"}},
    ],
    "created": 1758114955,
    "model": "m",
    "object": "chat.completion",
    "service_tier": None,
    "usage": {"completion_tokens": 304, "prompt_tokens": 812, "total_tokens": 1116, "prompt_tokens_details": {"cached_tokens": 3}},
    "kv_transfer_params": {"unknown": True},
}


def attempts(spark, *bodies):
    rows = [(str(i), 0, "ok", None, None, None, None, None, normalise(json.dumps(b))) for i, b in enumerate(bodies)]
    return spark.createDataFrame(
        rows, "id string, shard int, status string, error_class string, error_text string, "
        "http_status int, started_at timestamp, finished_at timestamp, body string",
    )


def test_response_projection_of_chat(spark, out):
    bare = {"choices": []}
    results = typed_results(attempts(spark, CHAT_BODY, bare), "chat-completion", "r", 0)
    results.select("id", "response").write.option("compression", "zstd").parquet(out)
    back = spark.read.parquet(out)
    assert back.schema == responses_schema("chat-completion")
    row = back.where("id = '0'").select("response").first().response
    assert [c.message.content for c in row.choices] == ["hi", "ho"]
    assert [e.content.token for e in row.choices[0].logprobs] == ["a", "c"]
    assert row.choices[0].logprobs[0].content.top_logprobs[0].logprob == -1.5
    assert row.choices[0].message.tool_calls[0].function.name == "f"
    assert row.choices[0].message.annotations[0].url_citation.url == "u"
    assert (row.usage.total_tokens, row.usage.prompt_tokens_details.cached_tokens, row.usage.completion_tokens_details) == (1116, 3, None)
    empty = back.where("id = '1'").select(content().alias("c"), finish_reason().alias("f"), *usage_columns()).first()
    assert empty.c is None and empty.f is None and empty.total_tokens is None


def test_response_projection_of_completion(spark):
    body = {
        "id": "cmpl-1",
        "choices": [
            {
                "finish_reason": "stop",
                "index": 0,
                "text": "out",
                "logprobs": {"text_offset": [0, 2], "token_logprobs": [-0.5, None], "tokens": ["o", "ut"], "top_logprobs": [{"o": -0.5, "u": -2.0}, None]},
            }
        ],
        "created": 1,
        "model": "m",
    }
    row = typed_results(attempts(spark, body), "completion", "r", 0).select(text().alias("t"), "response").first()
    assert row.t == "out"
    assert row.response.choices[0].logprobs.top_logprobs == [{"o": -0.5, "u": -2.0}, None]
    assert row.response.usage is None


@pytest.mark.parametrize("body", ["not json", "[]", '{"error": "x"}'])
def test_other_bodies_are_failures(body):
    class Odd:
        def call(self, request, deadline_s):
            return body

    assert {r["status"] for r in send(Odd(), n=3)} == {"error"}


def test_no_key_reaches_the_plan(spark):
    from inkwell.operators.client import HttpClientFactory

    rows = spark.createDataFrame([("a", "p")], "id string, prompt string")
    results = infer(rows, config(), HttpClientFactory("completion", "top-secret"))
    assert "top-secret" not in results._jdf.queryExecution().toString()


def test_named_transforms(spark):
    rows = spark.createDataFrame([("a", "x")], "id string, text string")
    assert apply_named(rows, None) is rows
    with pytest.raises(ValueError, match="not registered"):
        apply_named(rows, "nope")

    @register("upper_text")
    def upper_text(df, suffix=""):
        return df.withColumn("prompt", F.concat(F.upper("text"), F.lit(suffix)))

    assert apply_named(rows, "upper_text", {"suffix": "!"}).first().prompt == "X!"
    made = apply_named(rows, "template_messages", {"template": "<{document}>", "system": "s", "max_chars": 1})
    assert [m.content for m in made.first().messages] == ["s", "<x>"]
    assert apply_named(rows, "template_prompt", {"template": "<{document}>"}).first().prompt == "<x>"

    @register_rows("shout", "id string, prompt string")
    def shout(row, mark="!"):
        return {"id": "other", "prompt": row["text"] + mark}

    assert tuple(apply_named(rows, "shout", {"mark": "?"}).first()) == ("a", "x?")


def test_unknown_api_type():
    with pytest.raises(ValueError):
        response_ddl("speech")
