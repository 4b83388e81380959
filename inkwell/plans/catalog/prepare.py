"""Sources, prompts, validation and sharding over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions.content import image_part, parts, text_part
from inkwell.functions.prompts import conversation, fill, from_turns, prefill_flags_missing, truncate
from inkwell.functions.requests import chat_request, completion_request
from inkwell.functions.sharding import base_job_name, endpoint_for, shard_name, shard_of_job
from inkwell.operators.ordering import first_n
from inkwell.operators.resume import pending
from inkwell.operators.shard import contiguous_by_key, select_shard, shard_sizes, with_shard
from inkwell.operators.transforms import apply_named, register_rows
from inkwell.operators.validate import duplicate_ids, preview, validate
from inkwell.plans.catalog.registry import query, table
from inkwell.plans.catalog.shared import (
    NUM_SHARDS,
    PREFILL,
    SQL_PROMPT,
    SQL_SHARD,
    SQL_TRANSLATE,
    SYSTEM,
    TEMPLATE,
    TRANSLATE,
    documents,
)
from inkwell.session import scratch_path
from inkwell.sinks.tables import save_prepared
from inkwell.sinks.task_files import append_task_files
from inkwell.sources.inputs import describe_input, load_input

OPTIONS = {
    "temperature": 0.3,
    "max_tokens": 100,
    "top_p": 0.9,
    "frequency_penalty": 0.1,
    "presence_penalty": 0.2,
    "extra_body": {"min_tokens": 50, "continue_final_message": True, "add_generation_prompt": False},
}


@query("scan_projection", "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en'")
def scan_projection(spark, sf_dir):
    """Directory scan with the columns and the filter pushed into it."""
    return load_input(
        spark, "parquet", f"{sf_dir}/documents.parquet", columns=["doc_id", "source", "n_chars"], where="lang = 'en'"
    )


@query("input_description", "SELECT count(*) AS num_rows, CAST(1 AS BIGINT) AS num_files, CAST(5 AS INTEGER) AS num_columns FROM documents")
def input_description(spark, sf_dir):
    return describe_input(table(spark, sf_dir, "documents")).select("num_rows", "num_files", "num_columns")


@query(
    "load_arrow",
    "SELECT doc_id, n_chars FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2') AND n_chars > 100",
)
def load_arrow(spark, sf_dir):
    """Documents saved as Arrow files by tasks, read back with columns and filter inside the source."""
    path = scratch_path(spark, "arrow")
    docs = table(spark, sf_dir, "documents")
    if not append_task_files(docs, path, "arrow"):
        raise RuntimeError(f"tasks cannot write to {path}")
    where = "lang = 'en' AND source IN ('src1', 'src2') AND n_chars > 100"
    return load_input(spark, "arrow", path, columns=["doc_id", "n_chars"], where=where)


@query(
    "load_formats",
    """
SELECT f.fmt, count(*) AS num_rows, CAST(sum(doc_id) AS BIGINT) AS id_sum, CAST(sum(quality) AS BIGINT) AS quality_sum
FROM labels CROSS JOIN (VALUES ('csv'), ('json'), ('orc'), ('parquet')) f(fmt) GROUP BY f.fmt
""",
)
def load_formats(spark, sf_dir):
    """The same table loaded from each format."""
    labels = table(spark, sf_dir, "labels")
    schema = "doc_id bigint, quality int, toxic int"
    parts = None
    for fmt in ("csv", "json", "orc", "parquet"):
        path = scratch_path(spark, f"labels-{fmt}")
        labels.write.format(fmt).save(path)
        part = load_input(spark, fmt, path, schema=schema).agg(
            F.lit(fmt).alias("fmt"),
            F.count(F.lit(1)).alias("num_rows"),
            F.sum("doc_id").alias("id_sum"),
            F.sum("quality").alias("quality_sum"),
        )
        parts = part if parts is None else parts.unionByName(part)
    return parts


@query("split_input", "SELECT doc_id, toxic FROM labels WHERE quality = 1")
def split_input(spark, sf_dir):
    """One split of a folder that holds two."""
    labels = table(spark, sf_dir, "labels")
    path = scratch_path(spark, "splits")
    for split, quality in (("train", 1), ("rest", 0)):
        labels.where(F.col("quality") == quality).write.parquet(f"{path}/{split}")
    return load_input(spark, "parquet", path, split="train", columns=["doc_id", "toxic"])


@query("first_documents", "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents ORDER BY doc_id LIMIT 500")
def first_documents(spark, sf_dir):
    """The first n rows by id."""
    head = first_n(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), 500, "doc_id")
    return head.select("doc_id", "lang", F.md5("text").alias("text_md5"))


@query(
    "first_n_nulls",
    """
WITH rows AS (SELECT d.doc_id, l.quality, l.doc_id AS labelled FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT labelled, count(*) AS n FROM (SELECT labelled FROM rows ORDER BY labelled NULLS FIRST LIMIT 700) GROUP BY labelled
""",
)
def first_n_nulls(spark, sf_dir):
    """The first n rows over a key that is null for most of them."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("doc_id").alias("labelled"))
    rows = table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left")
    return first_n(rows, 700, "labelled").groupBy("labelled").agg(F.count(F.lit(1)).alias("n"))


@query(
    "truncate_prompt",
    "SELECT doc_id, CAST(length(substr(text, 1, 2000)) AS INTEGER) AS chars, md5(substr(text, 1, 2000)) AS text_md5 FROM documents",
)
def truncate_prompt(spark, sf_dir):
    """Character truncation; counts code points."""
    cut = truncate("text", 2000)
    return table(spark, sf_dir, "documents").select("doc_id", F.length(cut).alias("chars"), F.md5(cut).alias("text_md5"))


@query(
    "template_prompt",
    f"SELECT doc_id, CAST(length({SQL_PROMPT}) AS INTEGER) AS chars, md5({SQL_PROMPT}) AS prompt_md5 FROM documents",
)
def template_prompt(spark, sf_dir):
    prompt = fill(TEMPLATE, document="text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.length(prompt).alias("chars"), F.md5(prompt).alias("prompt_md5")
    )


@query(
    "conversation_user",
    f"SELECT doc_id, CAST(0 AS INTEGER) AS pos, 'user' AS role, md5({SQL_PROMPT}) AS content_md5 FROM documents",
)
def conversation_user(spark, sf_dir):
    messages = conversation(fill(TEMPLATE, document="text"))
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(messages).alias("pos", "m"))
    return lines.select("doc_id", "pos", "m.role", F.md5("m.content").alias("content_md5"))


@query(
    "conversation_prefill",
    f"""
SELECT doc_id, CAST(0 AS INTEGER) AS pos, 'system' AS role, md5('{SYSTEM}') AS content_md5 FROM documents
UNION ALL SELECT doc_id, 1, 'user', md5({SQL_TRANSLATE}) FROM documents
UNION ALL SELECT doc_id, 2, 'assistant', md5('{PREFILL}') FROM documents
""",
)
def conversation_prefill(spark, sf_dir):
    """System text, user text and the start of the reply."""
    messages = conversation(fill(TRANSLATE, document="text"), system=SYSTEM, prefill=PREFILL)
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(messages).alias("pos", "m"))
    return lines.select("doc_id", "pos", "m.role", F.md5("m.content").alias("content_md5"))


@query(
    "conversation_from_turns",
    """
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, role,
  md5(text) AS content_md5
FROM conversations
""",
)
def conversation_from_turns(spark, sf_dir):
    """Messages arrays from one row per turn, shown message by message."""
    built = from_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    lines = built.select("conv_id", F.posexplode("messages").alias("pos", "m"))
    return lines.select("conv_id", "pos", "m.role", F.md5("m.content").alias("content_md5"))


@query(
    "prefill_flags",
    """
SELECT conv_id, last_role = 'assistant' AS needs_flags FROM (
  SELECT conv_id, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id)
""",
)
def prefill_flags(spark, sf_dir):
    """Conversations that end with the assistant, sent without the flags to continue them."""
    built = from_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return built.select("conv_id", prefill_flags_missing("messages", {"temperature": 0.0}).alias("needs_flags"))


@query(
    "request_json_fields",
    f"""
SELECT doc_id, 'stub-model' AS model, '0.3' AS temperature, '100' AS max_tokens, '50' AS min_tokens,
  'system' AS first_role, md5({SQL_TRANSLATE}) AS content_md5, '{PREFILL}' AS prefill
FROM documents
""",
)
def request_json_fields(spark, sf_dir):
    """Chat request bodies, read back field by field."""
    messages = conversation(fill(TRANSLATE, document="text"), system=SYSTEM, prefill=PREFILL)
    body = chat_request("stub-model", messages, OPTIONS)

    def part(path, name):
        return F.get_json_object("body", path).alias(name)

    return table(spark, sf_dir, "documents").select("doc_id", body.alias("body")).select(
        "doc_id",
        part("$.model", "model"),
        part("$.temperature", "temperature"),
        part("$.max_tokens", "max_tokens"),
        part("$.min_tokens", "min_tokens"),
        part("$.messages[0].role", "first_role"),
        F.md5(F.get_json_object("body", "$.messages[1].content")).alias("content_md5"),
        part("$.messages[2].content", "prefill"),
    )


@query(
    "completion_request_fields",
    f"SELECT doc_id, 'stub-model' AS model, '0.9' AS top_p, md5({SQL_PROMPT}) AS prompt_md5 FROM documents",
)
def completion_request_fields(spark, sf_dir):
    body = completion_request("stub-model", fill(TEMPLATE, document="text"), OPTIONS)
    return table(spark, sf_dir, "documents").select("doc_id", body.alias("body")).select(
        "doc_id",
        F.get_json_object("body", "$.model").alias("model"),
        F.get_json_object("body", "$.top_p").alias("top_p"),
        F.md5(F.get_json_object("body", "$.prompt")).alias("prompt_md5"),
    )


@query(
    "save_prepared",
    f"SELECT CAST(doc_id AS VARCHAR) AS id, CAST(1 AS INTEGER) AS num_messages, md5({SQL_PROMPT}) AS content_md5 FROM documents",
)
def save_prepared_documents(spark, sf_dir):
    """The prepared dataset, saved and loaded again."""
    path = scratch_path(spark, "prepared")
    prepared = apply_named(documents(spark, sf_dir), "template_messages", {"template": TEMPLATE})
    save_prepared(prepared.select("id", "text", "messages"), path)
    return load_input(spark, "parquet", path).select(
        "id", F.size("messages").alias("num_messages"), F.md5(F.get("messages", F.lit(0))["content"]).alias("content_md5")
    )


def label_prompt(row, prefix):
    """A row function: a prompt from two columns."""
    return {**row, "id": "changed", "prompt": f"{prefix}{row['lang']}: {row['text']}"}


register_rows("label_prompt", "id string, prompt string")(label_prompt)


@query(
    "row_function",
    "SELECT CAST(doc_id AS VARCHAR) AS id, md5('doc in ' || lang || ': ' || text) AS prompt_md5 FROM documents",
)
def row_function(spark, sf_dir):
    """A registered row function; the id it writes is not taken."""
    rows = documents(spark, sf_dir).select("id", "lang", "text")
    out = apply_named(rows, "label_prompt", {"prefix": "doc in "})
    return out.select("id", F.md5("prompt").alias("prompt_md5"))


_SQL_RULE = "SELECT '{rule}' AS rule, '{severity}' AS severity, count(*) FILTER ({bad}) AS bad_rows, min(id) FILTER ({bad}) AS first_id FROM rows"


def _sql_report(rows: str, rules: list[tuple[str, ...]]) -> str:
    """SQL of a report; a rule is (name, condition) or (name, condition, severity)."""
    lines = [_SQL_RULE.format(rule=name, severity=(*kind, "error")[0], bad=bad) for name, bad, *kind in rules]
    empty = "SELECT 'empty', 'warning', CASE WHEN count(*) = 0 THEN 1 ELSE 0 END::BIGINT, NULL FROM rows"
    return f"WITH rows AS ({rows})\n" + "\nUNION ALL ".join([*lines, empty])


@query(
    "validate_completion",
    _sql_report(
        """
SELECT CASE doc_id % 19 WHEN 1 THEN NULL WHEN 2 THEN '' WHEN 3 THEN chr(160) || chr(9) WHEN 4 THEN chr(8195) || chr(28)
         ELSE CAST(doc_id AS VARCHAR) END AS id,
  CASE WHEN doc_id % 19 = 5 THEN NULL ELSE text END AS prompt FROM documents""",
        [
            ("id_null", "id IS NULL"),
            ("id_blank", "id IN ('', chr(160) || chr(9), chr(8195) || chr(28))"),
            ("prompt_not_string", "prompt IS NULL"),
        ],
    ),
)
def validate_completion(spark, sf_dir):
    """Documents with some ids and prompts made bad."""
    kind = F.col("doc_id") % 19
    row_id = (
        F.when(kind == 1, F.lit(None))
        .when(kind == 2, F.lit(""))
        .when(kind == 3, F.lit("\u00a0\t"))
        .when(kind == 4, F.lit("\u2003\x1c"))
        .otherwise(F.col("doc_id").cast("string"))
    )
    rows = table(spark, sf_dir, "documents").select(row_id.alias("id"), F.when(kind != 5, F.col("text")).alias("prompt"))
    return validate(rows, "completion", "prompt")


@query(
    "validate_chat",
    _sql_report(
        """
SELECT CAST(conv_id AS VARCHAR) AS id, conv_id % 17 = 9 AS is_null, conv_id % 17 = 7 AS is_empty,
  conv_id % 17 = 3 OR (conv_id % 17 = 5 AND bool_or(role <> 'assistant')) AS bad_message
FROM conversations GROUP BY conv_id""",
        [
            ("id_null", "id IS NULL"),
            ("id_blank", "id = ''"),
            ("messages_not_list", "is_null"),
            ("messages_empty", "is_empty"),
            ("message_invalid", "bad_message AND NOT is_null AND NOT is_empty"),
        ],
    ),
)
def validate_chat(spark, sf_dir):
    """Conversations, some without messages, with an unknown role or without content."""
    built = from_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    kind = F.col("conv_id") % 17
    good = F.col("messages")
    robot = F.transform(good, lambda m: F.struct(F.lit("robot").alias("role"), m["content"].alias("content")))
    silent = F.transform(good, lambda m: F.struct(m["role"].alias("role"), F.lit(None).cast("string").alias("content")))
    messages = (
        F.when(kind == 3, robot)
        .when(kind == 5, silent)
        .when(kind == 7, F.slice(good, 1, 0))
        .when(kind == 9, F.lit(None))
        .otherwise(good)
    )
    rows = built.select(F.col("conv_id").cast("string").alias("id"), messages.alias("messages"))
    return validate(rows, "chat-completion", "messages")


@query(
    "validate_parts",
    _sql_report(
        """
SELECT CAST(doc_id AS VARCHAR) AS id, doc_id % 9 IN (4, 8) AS bad_message, doc_id % 9 IN (2, 3, 5, 6, 8) AS bad_part
FROM documents""",
        [
            ("id_null", "id IS NULL"),
            ("id_blank", "id = ''"),
            ("messages_not_list", "FALSE"),
            ("messages_empty", "FALSE"),
            ("message_invalid", "bad_message"),
            ("part_invalid", "bad_part", "warning"),
        ],
    ),
)
def validate_parts(spark, sf_dir):
    """Documents as contents of parts: good ones, and parts of unknown types, without fields, or of another role."""
    docs = table(spark, sf_dir, "documents")
    kind, text = F.col("doc_id") % 9, text_part(F.col("text"))
    image = image_part(F.concat(F.lit("https://images.example.com/"), F.col("doc_id").cast("string")))
    content = (
        F.when(kind == 0, F.parse_json(F.lit('"plain text"')))
        .when(kind == 1, parts(text, image))
        .when(kind == 2, parts(text, F.lit('{"type": "image_url", "image_url": {}}')))
        .when(kind == 3, parts(text, F.lit('{"type": "video"}')))
        .when(kind == 4, F.parse_json(F.lit("null")))
        .when(kind == 5, F.parse_json(F.lit("[]")))
        .when(kind == 6, parts(F.lit('{"type": "text", "text": 7}')))
        .when(kind == 7, parts(image, text))
        .otherwise(F.parse_json(F.lit("12.5")))
    )
    rows = docs.select(
        F.col("doc_id").cast("string").alias("id"),
        F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))).alias("messages"),
    )
    return validate(rows, "chat-completion", "messages")


@query("duplicate_ids", "SELECT md5(text) AS id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicates(spark, sf_dir):
    """Ids that repeat, with the text's digest as the id."""
    return duplicate_ids(table(spark, sf_dir, "documents").select(F.md5("text").alias("id")))


@query(
    "preview_messages",
    """
WITH ids AS (SELECT DISTINCT conv_id FROM conversations ORDER BY conv_id LIMIT 10)
SELECT c.conv_id AS id, CAST(row_number() OVER (PARTITION BY c.conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, role, text AS content
FROM conversations c JOIN ids ON c.conv_id = ids.conv_id
""",
)
def preview_messages(spark, sf_dir):
    built = from_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return preview(built, 10, "messages", "conv_id")


@query("shard_contiguous", f"SELECT doc_id, CAST(ntile({NUM_SHARDS}) OVER (ORDER BY doc_id) - 1 AS INTEGER) AS shard FROM documents")
def shard_contiguous(spark, sf_dir):
    """Equal blocks in id order."""
    return contiguous_by_key(table(spark, sf_dir, "documents"), NUM_SHARDS, "doc_id")


@query(
    "shard_blocks",
    """
SELECT shard, count(*) AS num_rows FROM (
  SELECT CAST(ntile(7) OVER (ORDER BY doc_id) - 1 AS INTEGER) AS shard FROM documents) GROUP BY shard
""",
)
def shard_blocks(spark, sf_dir):
    """Sizes of equal blocks in stored order."""
    return shard_sizes(with_shard(table(spark, sf_dir, "documents"), 7, "contiguous"), 7)


@query(
    "shard_by_file",
    "SELECT count(*) AS num_rows, CAST(3 AS BIGINT) AS num_shards, CAST(6 AS BIGINT) AS num_files FROM documents",
)
def shard_by_file(spark, sf_dir):
    """Whole files dealt to shards; every row in one shard, every file in one shard."""
    path = scratch_path(spark, "files")
    table(spark, sf_dir, "documents").select("doc_id", "lang").repartition(6, "doc_id").write.parquet(path)
    placed = with_shard(spark.read.parquet(path).select("*", "_metadata"), 3, "file")
    per_file = placed.groupBy(F.col("_metadata.file_path").alias("file"), "shard").count()
    return per_file.agg(
        F.sum("count").alias("num_rows"),
        F.countDistinct("shard").alias("num_shards"),
        F.count(F.lit(1)).alias("num_files"),
    )


@query(
    "shard_hash",
    f"SELECT doc_id, {SQL_SHARD.format(id='CAST(doc_id AS VARCHAR)', n=NUM_SHARDS)} AS shard FROM documents",
)
def shard_hash(spark, sf_dir):
    return with_shard(table(spark, sf_dir, "documents").select("doc_id"), NUM_SHARDS, "hash", "doc_id")


@query(
    "shard_sizes",
    f"SELECT {SQL_SHARD.format(id='CAST(doc_id AS VARCHAR)', n=NUM_SHARDS)} AS shard, count(*) AS num_rows FROM documents GROUP BY 1",
)
def sizes(spark, sf_dir):
    return shard_sizes(with_shard(table(spark, sf_dir, "documents").select("doc_id"), NUM_SHARDS, "hash", "doc_id"), NUM_SHARDS)


@query(
    "shard_subset",
    f"""
SELECT doc_id, shard FROM (
  SELECT doc_id, {SQL_SHARD.format(id='CAST(doc_id AS VARCHAR)', n=NUM_SHARDS)} AS shard FROM documents) WHERE shard = 2
""",
)
def shard_subset(spark, sf_dir):
    """The rows of one shard."""
    return select_shard(with_shard(table(spark, sf_dir, "documents").select("doc_id"), NUM_SHARDS, "hash", "doc_id"), 2, NUM_SHARDS)


@query(
    "shard_names",
    """
SELECT shard, printf('shard%06d', shard) AS name,
  'http://host' || CAST(shard % 3 AS VARCHAR) || ':8000/v1' AS endpoint, CAST(shard AS INTEGER) AS parsed, 'my-job' AS base
FROM (SELECT DISTINCT unnest([user_id, user_id + 1234567]) AS shard FROM events)
""",
)
def shard_names(spark, sf_dir):
    """Shard names, endpoints of shards, and shard numbers read from job names."""
    users = table(spark, sf_dir, "events").select(
        F.explode(F.array("user_id", F.col("user_id") + 1234567)).alias("shard")
    ).distinct()
    job = F.format_string("my-job-%06d", F.col("shard"))
    endpoints = [f"http://host{i}:8000/v1" for i in range(3)]
    return users.select(
        "shard",
        shard_name("shard").alias("name"),
        endpoint_for("shard", endpoints).alias("endpoint"),
        shard_of_job(job).alias("parsed"),
        base_job_name(job).alias("base"),
    )


@query(
    "resume_pending",
    "SELECT doc_id, md5(text) AS text_md5 FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
)
def resume_pending(spark, sf_dir):
    """Documents without a label, as rows without a response."""
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")).distinct()
    rest = pending(table(spark, sf_dir, "documents").select("doc_id", "text"), done, "doc_id")
    return rest.select("doc_id", F.md5("text").alias("text_md5"))
