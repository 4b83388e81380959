"""Column expressions that build prompts and conversations."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def truncate(text: Column | str, n: int) -> Column:
    """The first `n` characters (code points)."""
    return F.substring(_col(text), 1, n)


def fill(template: str, **columns: Column | str) -> Column:
    """Put columns into the `{name}` places of a template.

    The template is cut once, on the driver, so a text that itself contains
    `{name}` is never filled a second time. `{{` and `}}` stand for braces.
    """
    parts: list[Column] = []
    for literal, name, spec, conversion in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is None:
            continue
        if spec or conversion:
            raise ValueError(f"format specs are not supported in a template: {{{name}}}")
        if name not in columns:
            raise ValueError(f"template needs a column for {{{name}}}")
        parts.append(_col(columns[name]).cast("string"))
    return F.concat(*parts) if parts else F.lit("")


def message(role: str, content: Column | str) -> Column:
    """One message; a plain string is taken as the text itself."""
    content = F.lit(content) if isinstance(content, str) else content
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def conversation(user: Column, system: Column | str | None = None, prefill: Column | str | None = None) -> Column:
    """Messages array: optional system text, the user text, optional start of the reply."""
    messages = [message("system", system)] if system is not None else []
    messages.append(message("user", user))
    if prefill is not None:
        messages.append(message("assistant", prefill))
    return F.array(*messages)


def from_turns(df: DataFrame, key: str, turn: str, role: str, text: str, into: str = "messages") -> DataFrame:
    """One row per conversation from a table with one row per turn, in turn order.

    A conversation is one request, so its turns have to meet in one row; the
    partial aggregation gathers them on the map side first.
    """
    turns = F.sort_array(F.collect_list(F.struct(F.col(turn), F.col(role).alias("role"), F.col(text).alias("content"))))
    return df.groupBy(key).agg(
        F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias(into)
    )


# Message fields of the chat API. Contents may be text or a list of parts, so they
# are kept as variants.
_OPEN_MESSAGES = (
    "array<struct<role:string, content:variant, name:string, tool_call_id:string, "
    "tool_calls:variant, function_call:variant>>"
)


def messages_from_json(text: Column | str) -> Column:
    """Messages from JSON text, with contents that are text or lists of parts.

    Null where the text is not a JSON list.
    """
    text = _col(text)
    return F.when(F.ltrim(text).startswith("["), F.from_json(text, _OPEN_MESSAGES))


def ends_with_assistant(messages: Column | str) -> Column:
    """Whether the reply is started by the request (assistant prefill)."""
    messages = _col(messages)
    return F.coalesce(F.try_element_at(messages, F.lit(-1))["role"] == "assistant", F.lit(False))


def prefill_flags_missing(messages: Column | str, completions_kwargs: dict) -> Column:
    """True where a prefilled row would not be continued by the server.

    Continuing needs continue_final_message = true and add_generation_prompt =
    false, in the options or in their extra_body.
    """
    options = {**completions_kwargs, **(completions_kwargs.get("extra_body") or {})}
    flags_set = options.get("continue_final_message") is True and options.get("add_generation_prompt") is False
    return ends_with_assistant(messages) & F.lit(not flags_set)
