"""Clients that answer one request: HTTP for real runs, a stub for tests."""

from __future__ import annotations

import http.client
import json
import random
import threading
import time
from collections.abc import Callable
from typing import Protocol
from urllib.parse import urlsplit

# (method, url, headers, body, timeout in seconds) -> (status, headers, body)
Transport = Callable[[str, str, dict, bytes, float], tuple[int, dict, bytes]]

# The statuses a request is repeated for, besides 5xx.
RETRY_STATUSES = (408, 409, 429)

PATHS = {"chat-completion": "/chat/completions", "completion": "/completions"}


class RequestFailed(Exception):
    """The endpoint did not give a usable response; `status` is its HTTP status, if it gave any."""

    def __init__(self, message: str = "", status: int | None = None) -> None:
        super().__init__(message)
        self.status = status


class DeadlineExceeded(Exception):
    """The time allowed for one request, retries included, has run out."""


class Client(Protocol):
    def call(self, request: str, deadline_s: float) -> str:
        """Answer a JSON request body with a JSON response body, or raise."""


class HttpClient:
    """OpenAI-compatible endpoint, with retries inside one overall deadline."""

    def __init__(
        self,
        base_url: str,
        api_type: str,
        api_key: str = "EMPTY",
        max_retries: int = 3,
        transport: Transport | None = None,
        sleep: Callable[[float], None] = time.sleep,
        clock: Callable[[], float] = time.monotonic,
        first_delay_s: float = 0.5,
        max_delay_s: float = 8.0,
    ) -> None:
        self.url = base_url.rstrip("/") + PATHS[api_type]
        self.headers = {"Content-Type": "application/json", "Authorization": f"Bearer {api_key}"}
        self.max_retries = max_retries
        self.transport = transport or KeepAliveTransport()
        self.sleep, self.clock = sleep, clock
        self.first_delay_s, self.max_delay_s = first_delay_s, max_delay_s

    def call(self, request: str, deadline_s: float) -> str:
        end = self.clock() + deadline_s
        body = request.encode("utf-8")
        for attempt in range(self.max_retries + 1):
            left = end - self.clock()
            if left <= 0:
                raise DeadlineExceeded(f"no response within {deadline_s:g}s")
            wait = None
            try:
                status, headers, answer = self.transport("POST", self.url, self.headers, body, left)
            except TimeoutError:
                failure = RequestFailed("Request timed out.")
            except (OSError, http.client.HTTPException) as error:
                failure = RequestFailed(f"Connection error: {error}")
            else:
                if 200 <= status < 300:
                    return answer.decode("utf-8")
                failure = RequestFailed(f"Error code: {status} - {answer.decode('utf-8', 'replace')}", status)
                if status not in RETRY_STATUSES and status < 500:
                    raise failure
                wait = _retry_after(headers)
            if self.clock() >= end:
                raise DeadlineExceeded(f"no response within {deadline_s:g}s")
            if attempt == self.max_retries:
                raise failure
            delay = wait if wait is not None else self._delay(attempt)
            self.sleep(min(delay, max(0.0, end - self.clock())))
        raise AssertionError("unreachable")

    def _delay(self, attempt: int) -> float:
        delay = min(self.first_delay_s * 2**attempt, self.max_delay_s)
        return delay * (1 - 0.25 * random.random())


def _retry_after(headers: dict) -> float | None:
    """Seconds to wait as the endpoint asks, if it is a plain number; the deadline bounds the wait."""
    value = {k.lower(): v for k, v in headers.items()}.get("retry-after")
    try:
        seconds = float(value)
    except (TypeError, ValueError):
        return None
    return seconds if seconds >= 0 else None


class KeepAliveTransport:
    """One open connection per thread and host."""

    def __init__(self) -> None:
        self._local = threading.local()

    def __call__(self, method: str, url: str, headers: dict, body: bytes, timeout: float) -> tuple[int, dict, bytes]:
        parts = urlsplit(url)
        end = time.monotonic() + timeout
        pool = self._local.__dict__.setdefault("pool", {})
        key = (parts.scheme, parts.netloc)
        connection = pool.get(key)
        if connection is None:
            kind = http.client.HTTPSConnection if parts.scheme == "https" else http.client.HTTPConnection
            connection = pool[key] = kind(parts.netloc, timeout=timeout)
        connection.timeout = timeout
        if connection.sock is not None:
            connection.sock.settimeout(timeout)
        try:
            connection.request(method, parts.path, body=body, headers=headers)
            response = connection.getresponse()
            return response.status, dict(response.getheaders()), _read_until(response, connection, end)
        except BaseException:
            connection.close()
            pool.pop(key, None)
            raise


def _read_until(response, connection, end: float) -> bytes:
    """The whole body, or a timeout at `end`, however slowly it trickles in."""
    parts = []
    while True:
        left = end - time.monotonic()
        if left <= 0:
            raise TimeoutError("the response was not complete in time")
        if connection.sock is not None:
            connection.sock.settimeout(left)
        part = response.read1(1 << 16)
        if not part:
            return b"".join(parts)
        parts.append(part)


class HttpClientFactory:
    """Makes a client for an endpoint inside a task."""

    def __init__(self, api_type: str, api_key: str = "EMPTY", max_retries: int = 3) -> None:
        self.api_type, self.api_key, self.max_retries = api_type, api_key, max_retries

    def __call__(self, endpoint: str) -> Client:
        return HttpClient(endpoint, self.api_type, self.api_key, self.max_retries)

    def __repr__(self) -> str:
        return f"HttpClientFactory({self.api_type!r})"


class StubClient:
    """Answers from the request alone, the same way each time, without a network.

    With n the characters of the prompt (of the texts of the last user message, for chat):
    text `<think>ok</think>\\n\\nEducational score: {n % 6}`, n // 4 prompt
    tokens and 8 completion tokens. `fail` maps n to an error text, "timeout" for
    a passed deadline, or None. `latency_s` is slept on every call.
    """

    def __init__(self, fail: Callable[[int], str | None] | None = None, latency_s: float = 0.0) -> None:
        self.fail, self.latency_s = fail, latency_s

    def __call__(self, endpoint: str) -> Client:
        return self

    def call(self, request: str, deadline_s: float) -> str:
        if self.latency_s:
            time.sleep(self.latency_s)
        body = json.loads(request)
        chat = "messages" in body
        if chat:
            users = [m.get("content") or "" for m in body["messages"] if m["role"] == "user"]
            last = users[-1] if users else ""
            texts = [last] if isinstance(last, str) else [part.get("text") or "" for part in last]
            n = sum(map(len, texts))
        else:
            n = len(body["prompt"])
        error = self.fail(n) if self.fail else None
        if error == "timeout":
            raise DeadlineExceeded(f"no response within {deadline_s:g}s")
        if error:
            raise RequestFailed(error)
        text = f"<think>ok</think>\n\nEducational score: {n % 6}"
        choice = {"finish_reason": "stop", "index": 0, "logprobs": None}
        if chat:
            choice["message"] = {"role": "assistant", "content": text, "refusal": None, "tool_calls": []}
        else:
            choice["text"] = text
        return json.dumps(
            {
                "id": f"stub-{n}",
                "object": "chat.completion" if chat else "text_completion",
                "created": 0,
                "model": body.get("model"),
                "choices": [choice],
                "usage": {"prompt_tokens": n // 4, "completion_tokens": 8, "total_tokens": n // 4 + 8},
            }
        )
