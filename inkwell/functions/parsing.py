"""Reading response structs and the texts inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def first_choice(response: Column | str = "response") -> Column:
    """The first choice; null when there is none."""
    return F.get(_col(response)["choices"], F.lit(0))


def content(response: Column | str = "response") -> Column:
    """Text of the first choice of a chat response."""
    return first_choice(response)["message"]["content"]


def text(response: Column | str = "response") -> Column:
    """Text of the first choice of a completion response."""
    return first_choice(response)["text"]


def finish_reason(response: Column | str = "response") -> Column:
    return first_choice(response)["finish_reason"]


def usage_columns(response: Column | str = "response") -> list[Column]:
    """Token usage as flat columns."""
    usage = _col(response)["usage"]
    plain = [usage[name].alias(name) for name in ("prompt_tokens", "completion_tokens", "total_tokens")]
    completion = usage["completion_tokens_details"]
    prompt = usage["prompt_tokens_details"]
    return plain + [
        completion["reasoning_tokens"].alias("reasoning_tokens"),
        completion["accepted_prediction_tokens"].alias("accepted_prediction_tokens"),
        completion["rejected_prediction_tokens"].alias("rejected_prediction_tokens"),
        completion["audio_tokens"].alias("completion_audio_tokens"),
        prompt["audio_tokens"].alias("prompt_audio_tokens"),
        prompt["cached_tokens"].alias("cached_tokens"),
    ]


def choices(df: DataFrame, response: str = "response") -> DataFrame:
    """One row per choice, keeping rows that have none."""
    others = [name for name in df.columns if name != response]
    return df.select(*others, F.posexplode_outer(F.col(response)["choices"]).alias("choice_pos", "choice"))


def parse_score(value: Column | str, label: str = "Educational score:", low: int = 0, high: int = 5) -> Column:
    """The whole number after `label`; null if it is absent or out of range."""
    pattern = r"\Q" + label + r"\E\s*(\d+)"
    score = F.regexp_extract(_col(value), pattern, 1).try_cast("int")
    return F.when(score.between(low, high), score)


def strip_think(value: Column | str) -> Column:
    """The text without its <think>...</think> blocks."""
    return F.regexp_replace(_col(value), r"(?s)<think>.*?</think>\s*", "")


def has_tag(value: Column | str, tag: str) -> Column:
    """Whether the reply was closed, that is, not cut off before its end tag."""
    return _col(value).contains(f"</{tag}>")


def until_tag(value: Column | str, tag: str) -> Column:
    """The text before the closing tag, without outer blanks.

    For replies that continue a prefilled `<tag>`, only the closing tag is in
    the text. A cut-off reply is returned whole; see `has_tag`.
    """
    return F.regexp_replace(F.substring_index(_col(value), f"</{tag}>", 1), r"^\s+|\s+$", "")
