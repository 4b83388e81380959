"""Request bodies as JSON text, built in the plan."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def merged_options(completions_kwargs: dict[str, Any] | None) -> dict[str, Any]:
    """Options as they go into the body: `extra_body` entries move to the top level."""
    options = dict(completions_kwargs or {})
    extra = options.pop("extra_body", None) or {}
    return {**options, **extra}


def _body(model: str, payload: Column, completions_kwargs: dict[str, Any] | None) -> Column:
    fixed = json.dumps({"model": model, **merged_options(completions_kwargs)}, ensure_ascii=False)
    # payload is {"<name>":<value>}: drop its opening brace and append it.
    return F.concat(F.lit(fixed[:-1] + ","), F.substr(payload, F.lit(2)))


def chat_request(model: str, messages: Column | str, completions_kwargs: dict[str, Any] | None = None) -> Column:
    """Chat body; null where the row has no messages."""
    messages = F.col(messages) if isinstance(messages, str) else messages
    body = _body(model, F.to_json(F.struct(messages.alias("messages"))), completions_kwargs)
    return F.when(messages.isNotNull(), body)


def completion_request(model: str, prompt: Column | str, completions_kwargs: dict[str, Any] | None = None) -> Column:
    """Completion body; null where the row has no prompt."""
    prompt = F.col(prompt) if isinstance(prompt, str) else prompt
    body = _body(model, F.to_json(F.struct(prompt.alias("prompt"))), completions_kwargs)
    return F.when(prompt.isNotNull(), body)


def request_body(api_type: str, model: str, value: Column | str, completions_kwargs: dict[str, Any] | None = None) -> Column:
    if api_type == "chat-completion":
        return chat_request(model, value, completions_kwargs)
    if api_type == "completion":
        return completion_request(model, value, completions_kwargs)
    raise ValueError(f"invalid api_type {api_type!r}")
