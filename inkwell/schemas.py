"""Table schemas, as Spark DDL.

The two response schemas are fixed values: they follow the public OpenAI
response objects, so tables written here can be read by any tool that expects
them, and the other way round.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

_USAGE = """struct<
    completion_tokens:int, prompt_tokens:int, total_tokens:int,
    completion_tokens_details:struct<
        accepted_prediction_tokens:int, audio_tokens:int,
        reasoning_tokens:int, rejected_prediction_tokens:int>,
    prompt_tokens_details:struct<audio_tokens:int, cached_tokens:int>>"""

_TOKEN_LOGPROB = """struct<
    token:string, bytes:array<int>, logprob:float,
    top_logprobs:array<struct<token:string, bytes:array<int>, logprob:float>>>"""

_CHAT_MESSAGE = """struct<
    content:string, refusal:string, role:string,
    annotations:array<struct<
        type:string,
        url_citation:struct<end_index:int, start_index:int, title:string, url:string>>>,
    audio:struct<id:string, data:string, expires_at:bigint, transcript:string>,
    function_call:struct<arguments:string, name:string>,
    tool_calls:array<struct<
        id:string, function:struct<arguments:string, name:string>, type:string>>>"""

CHAT_RESPONSE = f"""struct<
    id:string,
    choices:array<struct<
        finish_reason:string, index:int,
        logprobs:array<struct<content:{_TOKEN_LOGPROB}, refusal:{_TOKEN_LOGPROB}>>,
        message:{_CHAT_MESSAGE}>>,
    created:bigint, model:string, object:string, service_tier:string,
    system_fingerprint:string, usage:{_USAGE}>"""

COMPLETION_RESPONSE = f"""struct<
    id:string,
    choices:array<struct<
        finish_reason:string, index:int,
        logprobs:struct<
            text_offset:array<int>, token_logprobs:array<float>,
            tokens:array<string>, top_logprobs:array<map<string,float>>>,
        text:string>>,
    created:bigint, model:string, system_fingerprint:string, usage:{_USAGE}>"""

_RESPONSES = {"chat-completion": CHAT_RESPONSE, "completion": COMPLETION_RESPONSE}

MESSAGES = "array<struct<role:string, content:string>>"

# What a request task hands back to the JVM. The response body stays JSON text
# here and is parsed into its typed struct by from_json, outside Python.
ATTEMPTS = """id string, shard int, status string, error_class string, error_text string, http_status int,
    started_at timestamp, finished_at timestamp, body string"""

_RATES = """requests_per_second:double, total_tokens_per_second:double,
    prompt_tokens_per_second:double, completion_tokens_per_second:double,
    requests_per_hour:double, total_tokens_per_hour:double,
    prompt_tokens_per_hour:double, completion_tokens_per_hour:double"""

# One nested progress record per shard and report interval.
PROGRESS_RECORD = f"""
    timestamp double, shard int, num_shards int,
    progress struct<completed:bigint, total:bigint, new:bigint, existing:bigint,
                    eta_seconds:double, eta_formatted:string>,
    throughput struct<
        overall:struct<{_RATES}>,
        last_interval:struct<duration_seconds:double, new:bigint, existing:bigint, {_RATES}>>"""

RATE_NAMES = (
    "requests_per_second",
    "total_tokens_per_second",
    "prompt_tokens_per_second",
    "completion_tokens_per_second",
)

JOB_SNAPSHOT = "jobs array<struct<name:string, job_id:bigint, job_state:string>>"


def one_line(ddl: str) -> str:
    return " ".join(ddl.split())


def response_ddl(api_type: str) -> str:
    """DDL of the `response` struct for an API type."""
    try:
        return one_line(_RESPONSES[api_type])
    except KeyError:
        raise ValueError(f"invalid api_type {api_type!r}, expected one of {sorted(_RESPONSES)}")


def responses_schema(api_type: str) -> StructType:
    """Schema of the (id, response) output table."""
    return StructType.fromDDL(f"id string, response {response_ddl(api_type)}")


def results_schema(api_type: str) -> StructType:
    """Schema of the results table: one row per request attempt."""
    return StructType.fromDDL(
        "id string, run_id string, wave int, status string, error_class string, "
        "error_text string, http_status int, started_at timestamp, finished_at timestamp, "
        f"response {response_ddl(api_type)}, shard int"
    )


def progress_schema() -> StructType:
    return StructType.fromDDL(one_line(PROGRESS_RECORD))
