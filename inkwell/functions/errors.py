"""Error classes of a failed request."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

TIMEOUT = "timeout"
CONTEXT_LENGTH = "context_length"
API = "api"
OTHER = "other"

# The texts that decide the class of an error message, matched as
# plain lower-case substrings, context length before connection trouble.
CONTEXT_LENGTH_TEXTS = ("context length", "context_length", "too many tokens")
API_TEXTS = (
    "connection",
    "timeout",
    "timed out",
    "request timed out",
    "read timed out",
    "gateway timeout",
    "network",
    "unreachable",
    "refused",
    "reset",
    "unavailable",
    "service temporarily unavailable",
)

# Classes that count toward the failure breaker. A success ends a streak; the
# other two classes leave it as it is.
BREAKER_CLASSES = (TIMEOUT, API)


def _contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(or_, (text.contains(part) for part in parts))


def error_class(text: Column | str, timed_out: Column | bool = False) -> Column:
    """Class of an error text; null where there is no error."""
    text = F.col(text) if isinstance(text, str) else text
    timed_out = F.lit(timed_out) if isinstance(timed_out, bool) else timed_out
    lowered = F.lower(text)
    return (
        F.when(timed_out, F.lit(TIMEOUT))
        .when(text.isNull(), F.lit(None).cast("string"))
        .when(_contains_any(lowered, CONTEXT_LENGTH_TEXTS), F.lit(CONTEXT_LENGTH))
        .when(_contains_any(lowered, API_TEXTS), F.lit(API))
        .otherwise(F.lit(OTHER))
    )


def classify(text: str, timed_out: bool = False) -> str:
    """The same decision for one message, for use inside a request task."""
    if timed_out:
        return TIMEOUT
    lowered = text.lower()
    for name, parts in ((CONTEXT_LENGTH, CONTEXT_LENGTH_TEXTS), (API, API_TEXTS)):
        if any(part in lowered for part in parts):
            return name
    return OTHER
