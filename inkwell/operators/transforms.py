"""Named transforms applied to the input before validation and requests."""

from __future__ import annotations

import importlib
import importlib.util
import os
import sys
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from inkwell.functions.prompts import conversation, fill, truncate
from inkwell.sources.shipping import ship_package

Transform = Callable[..., DataFrame]

_REGISTRY: dict[str, Transform] = {}


def register(name: str) -> Callable[[Transform], Transform]:
    """Register `fn(df, **kwargs) -> df` under a name a config can use."""

    def add(fn: Transform) -> Transform:
        _REGISTRY[name] = fn
        return fn

    return add


def register_rows(name: str, schema: str | StructType, id_col: str = "id") -> Callable:
    """Register `fn(row: dict, **kwargs) -> dict`; `schema` is that of its output rows.

    Rows are handed over in Arrow batches. The id is always the one the row had
    before the function ran: results are matched by it.
    """

    def add(fn: Callable[..., dict[str, Any]]) -> Callable[..., dict[str, Any]]:
        def apply(df: DataFrame, **kwargs: Any) -> DataFrame:
            ship_package(df.sparkSession)
            return map_rows(df, fn, schema, id_col, kwargs)

        _REGISTRY[name] = apply
        return fn

    return add


def load_transforms(source: str) -> None:
    """Import a module, or a `.py` file, that registers transforms.

    Its functions are sent to tasks by value, so workers need not have it.
    """
    if source.endswith(".py"):
        name = "inkwell_user_" + os.path.splitext(os.path.basename(source))[0]
        spec = importlib.util.spec_from_file_location(name, source)
        module = importlib.util.module_from_spec(spec)
        sys.modules[name] = module
        spec.loader.exec_module(module)
    else:
        module = importlib.import_module(source)
    cloudpickle.register_pickle_by_value(module)


def map_rows(df: DataFrame, fn: Callable, schema: str | StructType, id_col: str, kwargs: dict) -> DataFrame:
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow_schema = to_arrow_schema(schema)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                row_id = row[id_col]
                new = dict(fn(row, **kwargs))
                new[id_col] = row_id
                out.append(new)
            yield pa.RecordBatch.from_pylist(out, schema=arrow_schema)

    return df.mapInArrow(apply, schema)


def apply_named(df: DataFrame, name: str | None, kwargs: dict[str, Any] | None = None) -> DataFrame:
    """Apply a registered transform; no name leaves the frame as it is."""
    if not name:
        return df
    if name not in _REGISTRY:
        raise ValueError(f"transform {name!r} is not registered, have {sorted(_REGISTRY)}")
    return _REGISTRY[name](df, **(kwargs or {}))


@register("template_messages")
def template_messages(
    df: DataFrame,
    template: str,
    text_col: str = "text",
    system: str | None = None,
    prefill: str | None = None,
    max_chars: int | None = None,
    into: str = "messages",
) -> DataFrame:
    """Messages from a template with a `{document}` place."""
    document = truncate(text_col, max_chars) if max_chars else F.col(text_col)
    return df.withColumn(into, conversation(fill(template, document=document), system, prefill))


@register("template_prompt")
def template_prompt(
    df: DataFrame, template: str, text_col: str = "text", max_chars: int | None = None, into: str = "prompt"
) -> DataFrame:
    """A completion prompt from a template with a `{document}` place."""
    document = truncate(text_col, max_chars) if max_chars else F.col(text_col)
    return df.withColumn(into, fill(template, document=document))
