import json

import pytest

from inkwell.functions.prompts import messages_from_json
from inkwell.functions.requests import chat_request
from inkwell.operators.validate import InvalidInputError, duplicate_ids, preview, validate

CHAT = "id string, messages array<struct<role:string,content:string,name:string,tool_call_id:string>>"


def report(df, api_type, col, **kw):
    return {r.rule: (r.bad_rows, r.first_id) for r in validate(df, api_type, col, **kw).collect()}


def chat(spark, *messages):
    rows = [(f"r{i}", m) for i, m in enumerate(messages)]
    return spark.createDataFrame(rows, CHAT)


def msg(role, content=None, name=None, tool_call_id=None):
    return (role, content, name, tool_call_id)


def test_bad_ids_and_prompts(spark):
    rows = [(None, "p"), ("", "p"), (" ", "p"), ("\t", "p"), (" ", "p"), ("\x1c ", "p"), ("a", None), (" b ", "p")]
    got = report(spark.createDataFrame(rows, "id string, prompt string"), "completion", "prompt")
    assert got == {"id_null": (1, None), "id_blank": (5, ""), "prompt_not_string": (1, "a"), "empty": (0, None)}


def test_blank_means_what_strip_removes(spark):
    blank = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    rows = [(c, "p") for c in blank] + [("​", "p"), ("﻿", "p"), ("x\n", "p")]
    got = report(spark.createDataFrame(rows, "id string, prompt string"), "completion", "prompt")
    assert got["id_blank"][0] == len(blank)


def test_types(spark):
    numbers = spark.createDataFrame([(1, 2)], "id int, prompt int")
    got = report(numbers, "completion", "prompt")
    assert got["id_not_string"] == (1, "1") and got["prompt_not_string"] == (1, "1")
    assert report(numbers, "chat-completion", "prompt")["messages_not_list"] == (1, "1")
    assert "id_not_string" not in report(numbers, "completion", "prompt", cast_id=True)
    with pytest.raises(InvalidInputError, match="cast"):
        validate(numbers, "completion", "prompt", mode="fail")


def test_message_rules(spark):
    good = [
        [msg("system", "s"), msg("user", "u"), msg("assistant")],
        [msg("developer", "d"), msg("tool", "t", tool_call_id="1"), msg("function", None, name="f")],
    ]
    bad = [
        [msg("robot", "x")],
        [msg(None, "x")],
        [msg("user")],
        [msg("tool", "t")],
        [msg("function", "t")],
        [msg("user", "ok"), msg("system")],
    ]
    got = report(chat(spark, *good, *bad, [], None), "chat-completion", "messages")
    assert got["message_invalid"] == (len(bad), "r2")
    assert got["messages_empty"] == (1, "r8") and got["messages_not_list"] == (1, "r9")


def test_messages_without_roles(spark):
    rows = spark.createDataFrame([("a", [("x",)])], "id string, messages array<struct<content:string>>")
    assert report(rows, "chat-completion", "messages")["message_invalid"] == (1, "a")


def test_missing_columns_are_named(spark):
    rows = spark.createDataFrame([("a", "p")], "id string, prompt string")
    for kwargs in ({"input_col": "text"}, {"input_col": "prompt", "id_col": "key"}):
        with pytest.raises(InvalidInputError, match="available columns"):
            validate(rows, "completion", **kwargs)


def test_empty_table_warns_and_passes(spark):
    empty = spark.createDataFrame([], "id string, prompt string")
    rows = {r.rule: r for r in validate(empty, "completion", "prompt", mode="fail").collect()}
    assert rows["empty"].bad_rows == 1 and rows["empty"].severity == "warning"


def test_fail_mode_and_sample(spark):
    rows = spark.createDataFrame([("a", "p"), ("b", None)], "id string, prompt string").coalesce(1)
    with pytest.raises(InvalidInputError, match="prompt_not_string: 1 rows, first id 'b'"):
        validate(rows, "completion", "prompt", mode="fail")
    validate(rows, "completion", "prompt", mode="fail", sample=1)


def test_unknown_arguments(spark):
    rows = spark.createDataFrame([("a", "p")], "id string, prompt string")
    for kw in ({"api_type": "speech"}, {"api_type": "completion", "mode": "warn"}):
        with pytest.raises(ValueError):
            validate(rows, input_col="prompt", **kw)


def test_duplicates(spark):
    rows = spark.createDataFrame([("a", "p"), ("a", "q"), ("b", "r")], "id string, prompt string")
    assert [(r.id, r.n) for r in duplicate_ids(rows).collect()] == [("a", 2)]
    assert report(rows, "completion", "prompt", check_unique=True)["id_repeated"] == (1, "a")


def test_preview(spark):
    rows = chat(spark, [msg("user", "a"), msg("assistant", "b")], [msg("user", "c")])
    got = [tuple(r) for r in preview(rows, 2).orderBy("id", "pos").collect()]
    assert got == [("r0", 0, "user", "a"), ("r0", 1, "assistant", "b"), ("r1", 0, "user", "c")]
    prompts = spark.createDataFrame([("b", "2"), ("a", "1")], "id string, prompt string")
    assert [tuple(r) for r in preview(prompts, 1, "prompt").collect()] == [("a", 0, "prompt", "1")]


def test_contents_of_many_parts(spark):
    rows = [
        ("a", '[{"role": "user", "content": [{"type": "text", "text": "hi"}]}, {"role": "assistant", "content": null}]'),
        ("b", '[{"role": "user", "content": "hi"}]'),
        ("c", '[{"role": "user", "content": null}]'),
        ("d", '{"role": "user"}'),
        ("e", "not json"),
    ]
    frame = spark.createDataFrame(rows, "id string, raw string").withColumn("messages", messages_from_json("raw"))
    got = report(frame, "chat-completion", "messages")
    assert got["message_invalid"] == (1, "c") and got["messages_not_list"] == (2, "d")
    bodies = {r.id: r.b for r in frame.select("id", chat_request("m", "messages").alias("b")).collect()}
    assert json.loads(bodies["a"])["messages"][0] == {"role": "user", "content": [{"type": "text", "text": "hi"}]}
    assert json.loads(bodies["b"])["messages"] == [{"role": "user", "content": "hi"}]


def test_prefilled_rows_without_flags_are_a_warning(spark):
    rows = chat(spark, [msg("user", "a"), msg("assistant", "<t>")], [msg("user", "c")])
    got = validate(rows, "chat-completion", "messages", mode="fail", completions_kwargs={"temperature": 0.0}).collect()
    assert {(r.severity, r.bad_rows, r.first_id) for r in got if r.rule == "prefill_without_flags"} == {("warning", 1, "r0")}
    flags = {"continue_final_message": True, "add_generation_prompt": False}
    assert report(rows, "chat-completion", "messages", completions_kwargs=flags)["prefill_without_flags"] == (0, None)


PARTS = [
    ("user", '"text"', "text", True), ("user", '[{"type": "text", "text": "a"}, {"type": "image_url", "image_url": {"url": "u"}}]', "parts", True),
    ("user", '[{"type": "image_url", "image_url": {"url": 3}}]', "parts", False), ("user", '[{"type": "video", "url": "u"}]', "parts", False),
    ("user", "[]", "parts", False), ("user", "null", "null", True), ("user", "12", "other", False), ("user", '{"type": "text"}', "other", False),
    ("user", '["text"]', "parts", False), ("user", '[{"text": "a"}]', "parts", False), ("user", '[null]', "parts", False),
    ("user", '[{"type": "input_audio", "input_audio": {"data": "x", "format": "mp3"}}]', "parts", True),
    ("user", '[{"type": "input_audio", "input_audio": {"data": "x", "format": "ogg"}}]', "parts", False),
    ("user", '[{"type": "file", "file": {}}]', "parts", True), ("user", '[{"type": "refusal", "refusal": "no"}]', "parts", False),
    ("assistant", '[{"type": "refusal", "refusal": "no"}]', "parts", True), ("assistant", '[{"type": "image_url", "image_url": {"url": "u"}}]', "parts", False),
    ("system", '[{"type": "text", "text": "a"}]', "parts", True), ("system", '[{"type": "image_url", "image_url": {"url": "u"}}]', "parts", False),
    ("tool", '[{"type": "text", "text": ""}]', "parts", True), ("tool", '[{"type": "text", "text": null}]', "parts", False),
]


def test_contents_as_parts(spark):
    from pyspark.sql import functions as F

    from inkwell.functions.content import kind_of, parts_are_valid

    df = spark.createDataFrame([(i, role, raw) for i, (role, raw, _, _) in enumerate(PARTS)], "i int, role string, raw string")
    df = df.withColumn("content", F.parse_json("raw"))
    got = df.select("i", kind_of(F.col("content")), parts_are_valid(F.col("content"), F.col("role"))).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [(kind, good) for _, _, kind, good in PARTS]


def test_parts_are_built_counted_and_sent_as_they_are(spark):
    import json

    from pyspark.sql import functions as F

    from inkwell.functions.content import image_part, parts, text_of, text_part
    from inkwell.functions.requests import chat_request

    df = spark.createDataFrame([("a\n\"ü", "http://x/1"), ("b", None)], "t string, u string")
    df = df.withColumn("content", parts(text_part(F.col("t")), image_part(F.col("u"))))
    messages = F.array(F.struct(F.lit("user").alias("role"), F.col("content").alias("content")))
    rows = df.select(chat_request("m", messages).alias("body"), text_of(F.col("content")).alias("text")).collect()
    contents = [json.loads(r.body)["messages"][0]["content"] for r in rows]
    image = {"type": "image_url", "image_url": {"url": "http://x/1"}}
    assert contents == [[{"type": "text", "text": "a\n\"ü"}, image], [{"type": "text", "text": "b"}]]
    assert [r.text for r in rows] == ["a\n\"ü", "b"]


def test_bad_parts_are_reported_and_do_not_stop_a_run(spark):
    rows = [("a", '[{"role": "user", "content": [{"type": "video"}]}]'), ("b", '[{"role": "user", "content": 5}]')]
    frame = spark.createDataFrame(rows, "id string, raw string").withColumn("messages", messages_from_json("raw"))
    report = {r.rule: (r.severity, r.bad_rows) for r in validate(frame, "chat-completion", "messages").collect()}
    assert report["part_invalid"] == ("warning", 2) and report["message_invalid"] == ("error", 1)
    validate(frame.where("id = 'a'"), "chat-completion", "messages", mode="fail")
