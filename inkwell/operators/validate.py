"""Whole-table input checks, all rules in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType, VariantType

from inkwell.functions.content import kind_of, parts_are_valid
from inkwell.functions.prompts import prefill_flags_missing

# The message roles of the public chat API.
ROLES = ("developer", "system", "user", "assistant", "tool", "function")

# Letters that count as blank at the ends of an id.
_BLANK = r"(?U)\A[\s\x1c-\x1f\x85]*\z"

# Servers differ in the parts they take, so parts are reported and do not stop a run.
WARNINGS = ("part_invalid",)

REPORT_SCHEMA = "rule string, severity string, bad_rows bigint, first_id string"


class InvalidInputError(ValueError):
    """The input breaks one or more rules; the message names them."""


def is_blank(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return text.rlike(_BLANK)


def message_is_valid(message: Column, fields: dict[str, DataType]) -> Column:
    """One message against the chat API's rules for its role."""

    def has(name: str) -> Column:
        if name not in fields:
            return F.lit(False)
        value = message[name]
        if isinstance(fields[name], VariantType) and name == "content":
            return kind_of(value).isin("text", "parts")
        if isinstance(fields[name], VariantType):
            return value.isNotNull() & ~F.is_variant_null(value)
        return value.isNotNull()

    role = message["role"]
    return F.coalesce(
        F.when(role == "assistant", F.lit(True))
        .when(role == "tool", has("content") & has("tool_call_id"))
        .when(role == "function", has("name"))
        .otherwise(role.isin(*ROLES) & has("content")),
        F.lit(False),
    )


def _rules(df: DataFrame, api_type: str, input_col: str, id_col: str) -> list[tuple[str, Column]]:
    schema = df.schema
    row_id, value = F.col(id_col), F.col(input_col)
    rules = [("id_null", row_id.isNull())]
    if isinstance(schema[id_col].dataType, StringType):
        rules.append(("id_blank", is_blank(row_id)))
    else:
        rules.append(("id_not_string", row_id.isNotNull()))
    kind = schema[input_col].dataType
    if api_type == "completion":
        is_string = isinstance(kind, StringType)
        rules.append(("prompt_not_string", value.isNull() if is_string else F.lit(True)))
        return rules
    element = kind.elementType if isinstance(kind, ArrayType) else None
    if not isinstance(element, StructType):
        rules.append(("messages_not_list", F.lit(True)))
        return rules
    rules.append(("messages_not_list", value.isNull()))
    rules.append(("messages_empty", F.size(value) == 0))
    fields = {f.name: f.dataType for f in element.fields}
    if "role" in fields:
        bad = F.exists(value, lambda m: ~message_is_valid(m, fields))
    else:
        bad = F.size(value) > 0
    rules.append(("message_invalid", bad))
    if "role" in fields and isinstance(fields.get("content"), VariantType):
        rules.append(("part_invalid", F.exists(value, lambda m: ~parts_are_valid(m["content"], m["role"]))))
    return rules


def _is_message_list(df: DataFrame, input_col: str) -> bool:
    kind = df.schema[input_col].dataType
    return isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType) and "role" in kind.elementType.names


def validate(
    df: DataFrame,
    api_type: str,
    input_col: str,
    id_col: str = "id",
    mode: str = "report",
    sample: int | None = None,
    cast_id: bool = False,
    check_unique: bool = False,
    completions_kwargs: dict | None = None,
) -> DataFrame:
    """Rows that break each rule: rule, severity, bad_rows, first_id.

    One aggregation over the table; only `check_unique` needs a shuffle, of ids
    alone. `mode="fail"` reads the report (one row per rule) and raises if any
    error rule has bad rows. `sample` checks that many rows only. With
    `completions_kwargs`, chats that end with the assistant are counted as a
    warning where the options do not tell the server to continue them.
    """
    if api_type not in ("completion", "chat-completion"):
        raise ValueError(f"invalid api_type {api_type!r}")
    if mode not in ("report", "fail"):
        raise ValueError("mode must be 'report' or 'fail'")
    for name in (input_col, id_col):
        if name not in df.columns:
            raise InvalidInputError(f"column {name!r} not found, available columns: {df.columns}")
    if cast_id:
        df = df.withColumn(id_col, F.col(id_col).cast("string"))
    if sample is not None:
        df = df.limit(sample)
    rules = [
        (rule, "warning" if rule in WARNINGS else "error", bad) for rule, bad in _rules(df, api_type, input_col, id_col)
    ]
    if completions_kwargs is not None and api_type == "chat-completion" and _is_message_list(df, input_col):
        rules.append(("prefill_without_flags", "warning", prefill_flags_missing(input_col, completions_kwargs)))
    measures = [F.count(F.lit(1)).alias("num_rows")]
    for i, (_, _, bad) in enumerate(rules):
        bad = F.coalesce(bad, F.lit(False))
        measures.append(F.count_if(bad).alias(f"n{i}"))
        measures.append(F.min(F.when(bad, F.col(id_col).cast("string"))).alias(f"first{i}"))
    lines = [_line(rule, kind, F.col(f"n{i}"), F.col(f"first{i}")) for i, (rule, kind, _) in enumerate(rules)]
    empty = F.when(F.col("num_rows") == 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    lines.append(_line("empty", "warning", empty, F.lit(None).cast("string")))
    report = df.agg(*measures).select(F.inline(F.array(*lines)))
    if check_unique:
        repeated = duplicate_ids(df, id_col)
        report = report.unionByName(
            repeated.agg(F.count(F.lit(1)).alias("bad_rows"), F.min(F.col(id_col).cast("string")).alias("first_id"))
            .select(F.lit("id_repeated").alias("rule"), F.lit("error").alias("severity"), "bad_rows", "first_id")
        )
    if mode == "fail":
        rows = report.collect()
        bad = [r for r in rows if r.severity == "error" and r.bad_rows]
        if bad:
            raise InvalidInputError(
                "; ".join(f"{r.rule}: {r.bad_rows} rows, first id {r.first_id!r}" for r in bad)
                + (" (cast the id column to string or set cast_id)" if any(r.rule == "id_not_string" for r in bad) else "")
            )
        return df.sparkSession.createDataFrame(rows, REPORT_SCHEMA)
    return report


def _line(rule: str, severity: str, bad_rows: Column, first_id: Column) -> Column:
    return F.struct(
        F.lit(rule).alias("rule"),
        F.lit(severity).alias("severity"),
        bad_rows.alias("bad_rows"),
        first_id.alias("first_id"),
    )


def duplicate_ids(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Ids that occur more than once, with their row counts."""
    return df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def preview(df: DataFrame, n: int = 10, input_col: str = "messages", id_col: str = "id") -> DataFrame:
    """The first `n` rows by id, one line per message: id, pos, role, content."""
    head = df.orderBy(id_col).limit(n)
    if isinstance(df.schema[input_col].dataType, ArrayType):
        lines = head.select(F.col(id_col).alias("id"), F.posexplode(input_col).alias("pos", "message"))
        return lines.select("id", "pos", "message.role", "message.content")
    return head.select(
        F.col(id_col).alias("id"),
        F.lit(0).alias("pos"),
        F.lit("prompt").alias("role"),
        F.col(input_col).alias("content"),
    )
