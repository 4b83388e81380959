import http.client
import json

import pytest

from inkwell.operators.client import DeadlineExceeded, HttpClient, HttpClientFactory, RequestFailed, StubClient


class Clock:
    def __init__(self):
        self.now = 0.0
        self.slept = []

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.slept.append(seconds)
        self.now += seconds


def client(answers, clock=None, max_retries=3, cost=0.0):
    clock = clock or Clock()
    calls = []

    def transport(method, url, headers, body, timeout):
        calls.append((method, url, headers, json.loads(body), timeout))
        clock.now += cost
        answer = answers[min(len(calls), len(answers)) - 1]
        if isinstance(answer, Exception):
            raise answer
        return answer

    made = HttpClient("http://h:1/v1/", "chat-completion", "key", max_retries, transport, clock.sleep, clock)
    return made, calls, clock


OK = (200, {}, b'{"choices": []}')


def test_request_goes_to_the_chat_path_with_the_key():
    made, calls, _ = client([OK])
    assert made.call('{"a": 1}', 300) == '{"choices": []}'
    method, url, headers, body, timeout = calls[0]
    assert (method, url, body, timeout) == ("POST", "http://h:1/v1/chat/completions", {"a": 1}, 300)
    assert headers["Authorization"] == "Bearer key"
    assert HttpClientFactory("completion")("http://x/v1").url == "http://x/v1/completions"


@pytest.mark.parametrize("failure", [(500, {}, b"x"), (429, {}, b"x"), (408, {}, b""), (409, {}, b""), OSError("refused"),
                                     http.client.RemoteDisconnected("x"), TimeoutError()])
def test_passing_failures_are_repeated(failure):
    made, calls, clock = client([failure, failure, OK])
    assert made.call("{}", 300) == '{"choices": []}'
    assert len(calls) == 3 and len(clock.slept) == 2


def test_retries_end():
    made, calls, _ = client([(503, {}, b"Service Unavailable")], max_retries=2)
    with pytest.raises(RequestFailed, match="Error code: 503 - Service Unavailable"):
        made.call("{}", 300)
    assert len(calls) == 3


def test_lasting_failures_are_not_repeated():
    made, calls, _ = client([(400, {}, b"maximum context length")])
    with pytest.raises(RequestFailed, match="Error code: 400 - maximum context length"):
        made.call("{}", 300)
    assert len(calls) == 1


def test_deadline_covers_retries():
    made, calls, clock = client([(500, {}, b"x")], max_retries=1000, cost=4.0)
    with pytest.raises(DeadlineExceeded):
        made.call("{}", 10)
    assert len(calls) <= 3 and clock.now <= 14.0
    assert calls[1][4] < 10


def test_retry_after_is_followed():
    made, _, clock = client([(429, {"Retry-After": "7"}, b""), OK])
    made.call("{}", 300)
    assert clock.slept == [7.0]


def test_no_key_in_the_factory_text():
    assert "secret" not in repr(HttpClientFactory("completion", "secret"))


def test_stub_is_deterministic():
    request = json.dumps({"model": "m", "messages": [{"role": "user", "content": "x" * 13}]})
    answer = json.loads(StubClient().call(request, 1))
    assert answer["choices"][0]["message"]["content"].endswith("Educational score: 1")
    assert answer["usage"] == {"prompt_tokens": 3, "completion_tokens": 8, "total_tokens": 11}
