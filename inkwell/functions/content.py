"""Message contents as text or as lists of parts, kept as variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The parts of the public chat API by role, and what each part must hold.
ROLE_PARTS = {
    "user": ("text", "image_url", "input_audio", "file"),
    "assistant": ("text", "refusal"),
    "system": ("text",),
    "developer": ("text",),
    "tool": ("text",),
}
PART_FIELDS = {
    "text": (("$.text", None),),
    "image_url": (("$.image_url.url", None),),
    "input_audio": (("$.input_audio.data", None), ("$.input_audio.format", ("wav", "mp3"))),
    "refusal": (("$.refusal", None),),
}


def kind_of(content: Column) -> Column:
    """`text`, `parts`, `null` or `other`, of a variant."""
    schema = F.schema_of_variant(content)
    return (
        F.when(content.isNull() | F.is_variant_null(content), "null")
        .when(schema == "STRING", "text")
        .when(schema.startswith("ARRAY<"), "parts")
        .otherwise("other")
    )


def parts_of(content: Column) -> Column:
    """The parts of a content; null where it is not a list."""
    return F.try_variant_get(content, "$", "array<variant>")


def _string_at(part: Column, path: str) -> Column:
    """The text at a path, null for any other kind of value there."""
    value = F.try_variant_get(part, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(part, path, "string"))


def part_is_valid(part: Column, role: Column) -> Column:
    """Whether a part is of a type that its role may send, with the fields of that type."""
    kind = _string_at(part, "$.type")
    allowed = F.lit(False)
    for name, kinds in ROLE_PARTS.items():
        allowed = F.when(role == name, kind.isin(*kinds)).otherwise(allowed)
    complete = kind == "file"
    for name, fields in PART_FIELDS.items():
        held = F.lit(True)
        for path, values in fields:
            value = _string_at(part, path)
            held = held & (value.isin(*values) if values else value.isNotNull())
        complete = F.when(kind == name, held).otherwise(complete)
    return F.coalesce(allowed & complete, F.lit(False))


def parts_are_valid(content: Column, role: Column) -> Column:
    """Whether a content is text, or a list of at least one part, all valid. A missing content is judged elsewhere."""
    parts = parts_of(content)
    listed = (F.size(parts) > 0) & F.forall(parts, lambda p: part_is_valid(p, role))
    kind = kind_of(content)
    return F.when(kind == "parts", F.coalesce(listed, F.lit(False))).otherwise(kind.isin("text", "null"))


def text_of(content: Column) -> Column:
    """The text of a content: itself, or its text parts joined by line breaks."""
    texts = F.filter(F.transform(parts_of(content), lambda p: _string_at(p, "$.text")), lambda t: t.isNotNull())
    return F.when(kind_of(content) == "text", F.try_variant_get(content, "$", "string")).otherwise(F.array_join(texts, "\n"))


def text_part(text: Column | str) -> Column:
    """JSON of a text part."""
    text = F.lit(text) if isinstance(text, str) else text
    return F.to_json(F.struct(F.lit("text").alias("type"), text.alias("text")))


def image_part(url: Column) -> Column:
    """JSON of an image part; null, to be left out, without an address."""
    body = F.to_json(F.struct(F.lit("image_url").alias("type"), F.struct(url.alias("url")).alias("image_url")))
    return F.when(url.isNotNull(), body)


def parts(*each: Column) -> Column:
    """A content of parts; those that are null are left out."""
    return F.parse_json(F.concat(F.lit("["), F.concat_ws(",", *each), F.lit("]")))
