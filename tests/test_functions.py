import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.functions.errors import classify, error_class
from inkwell.functions.formatting import (
    bar,
    count_text,
    epoch_timestamp,
    format_duration,
    one_decimal,
    or_missing,
    percent_text,
    rate_text,
    timestamp_text,
)
from inkwell.functions.parsing import has_tag, parse_score, strip_think, until_tag
from inkwell.functions.prompts import conversation, fill, from_turns, prefill_flags_missing, truncate
from inkwell.functions.requests import chat_request, completion_request, request_body
from inkwell.functions.sharding import (
    base_job_name,
    block_shard,
    check_shard,
    check_shards,
    endpoint_for,
    hash_shard,
    shard_name,
    shard_of_job,
)


def one(spark, value, sql="SELECT 1"):
    return spark.sql(sql).select(value.alias("v")).first().v


def test_one_decimal_is_rounded_from_the_stored_value(spark):
    random.seed(1)
    values = [0.0, 0.05, 0.25, 0.35, 1.45, 2.5, 99.95, 59.95, 1e9 + 0.05]
    values += [random.random() * 10 ** random.randint(-2, 9) for _ in range(2000)]
    values += [round(random.random() * 1000, 2) for _ in range(2000)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for r in rows.select("v", one_decimal("v").alias("a"), one_decimal("v", thousands=True).alias("b")).collect():
        assert (r.a, r.b) == (f"{r.v:.1f}", f"{r.v:,.1f}")


@pytest.mark.parametrize(
    "seconds, text",
    [(24869.9, "6.9h"), (45389.35, "12.6h"), (59.9, "59.9s"), (90.0, "1.5m"), (0.0, "0.0s"), (3600.0, "1.0h"), (None, None)],
)
def test_format_duration(spark, seconds, text):
    assert one(spark, format_duration(F.lit(seconds).cast("double"))) == text


def test_display_texts(spark):
    assert one(spark, rate_text(F.lit(13116.6))) == "13,116.6"
    assert one(spark, rate_text(F.lit(None).cast("double"))) == "-"
    assert one(spark, percent_text(F.lit(0.56))) == "0.6%"
    assert one(spark, count_text(F.lit(1000000))) == "1,000,000"
    assert one(spark, or_missing(F.lit(""))) == "N/A"
    assert one(spark, timestamp_text(epoch_timestamp(F.lit(1751465045.2584667)))) == "2025-07-02 14:04:05"


def test_bars_are_floored(spark):
    values = [1771, 2151, 2353, 2450, 2588, 2629, 2758, 2693]
    lengths = [32, 38, 42, 44, 46, 47, 50, 48]
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").select(bar("v", F.lit(2758.0)).alias("b"))
    assert [len(r.b) for r in rows.collect()] == lengths
    assert one(spark, bar(F.lit(0.0), F.lit(0.0))) == ""


@pytest.mark.parametrize(
    "text, timed_out, expected",
    [
        ("anything", True, "timeout"),
        ("maximum Context Length is 16384", False, "context_length"),
        ("too many tokens, connection closed", False, "context_length"),
        ("Connection refused", False, "api"),
        ("unknown presets", False, "api"),
        ("bad request", False, "other"),
        ("Gateway Timeout", False, "api"),
    ],
)
def test_error_classes(spark, text, timed_out, expected):
    assert classify(text, timed_out) == expected
    assert one(spark, error_class(F.lit(text), timed_out)) == expected


def test_no_error_has_no_class(spark):
    assert one(spark, error_class(F.lit(None).cast("string"))) is None


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(max_size=60).filter(lambda t: "\x00" not in t), min_size=50, max_size=100))
def test_template_fill_is_literal(spark, texts):
    rows = spark.createDataFrame([(text, "B{a}") for text in texts], "a string, b string")
    for r in rows.select("a", fill("{{x}} {a} $1 {b}", a="a", b="b").alias("v")).collect():
        assert r.v == f"{{x}} {r.a} $1 B{{a}}"


def test_template_errors(spark):
    with pytest.raises(ValueError):
        fill("{document}", text="a")
    with pytest.raises(ValueError):
        fill("{document:>5}", document="a")


def test_truncate_counts_code_points(spark):
    assert one(spark, truncate(F.lit("aé😀b"), 3)) == "aé😀"


def test_conversations(spark):
    messages = one(spark, conversation(F.lit("hi"), "sys", "<a>"))
    assert [(m.role, m.content) for m in messages] == [("system", "sys"), ("user", "hi"), ("assistant", "<a>")]
    turns = spark.createDataFrame([(1, 2, "user", "c"), (1, 0, "user", "a"), (1, 1, "assistant", "b")], "k int, t int, r string, x string")
    built = from_turns(turns, "k", "t", "r", "x").first().messages
    assert [m.content for m in built] == ["a", "b", "c"]


def test_prefill_flags(spark):
    prefilled = conversation(F.lit("q"), prefill="<a>")
    flags = {"extra_body": {"continue_final_message": True, "add_generation_prompt": False}}
    assert one(spark, prefill_flags_missing(prefilled, {})) is True
    assert one(spark, prefill_flags_missing(prefilled, flags)) is False
    assert one(spark, prefill_flags_missing(conversation(F.lit("q")), {})) is False


def test_request_bodies(spark):
    options = {"temperature": 0.0, "extra_body": {"min_tokens": 50}, "stop": ["\n", '"']}
    body = json.loads(one(spark, chat_request("m/é", conversation(F.lit('say "hi"\n')), options)))
    assert body == {
        "model": "m/é",
        "temperature": 0.0,
        "min_tokens": 50,
        "stop": ["\n", '"'],
        "messages": [{"role": "user", "content": 'say "hi"\n'}],
    }
    assert json.loads(one(spark, completion_request("m", F.lit("p")))) == {"model": "m", "prompt": "p"}
    assert one(spark, completion_request("m", F.lit(None).cast("string"))) is None
    with pytest.raises(ValueError):
        request_body("speech", "m", "c")


def test_null_message_fields_are_left_out(spark):
    sql = "SELECT array(named_struct('role','user','content','a','name',cast(null as string))) AS m"
    body = json.loads(spark.sql(sql).select(chat_request("m", "m").alias("v")).first().v)
    assert body["messages"] == [{"role": "user", "content": "a"}]


def test_parsers(spark):
    reply = "<think>\nscore? Educational score: 4\n</think>\n\nFine.\nEducational score: 2"
    assert one(spark, parse_score(strip_think(F.lit(reply)))) == 2
    assert one(spark, parse_score(F.lit("Educational score:  9"))) is None
    assert one(spark, parse_score(F.lit("none"))) is None
    assert one(spark, until_tag(F.lit("\nDiese\n</translated_document>\nx"), "translated_document")) == "Diese"
    assert one(spark, has_tag(F.lit("cut off"), "translated_document")) is False
    assert one(spark, until_tag(F.lit("cut off"), "translated_document")) == "cut off"


def test_shard_functions(spark):
    assert one(spark, shard_name(F.lit(12))) == "shard000012"
    assert one(spark, shard_of_job(F.lit("fw-edu-000007"))) == 7
    assert one(spark, shard_of_job(F.lit("fw-edu"))) is None
    assert one(spark, base_job_name(F.lit("fw-edu-000007"))) == "fw-edu"
    assert one(spark, endpoint_for(F.lit(5), ["a", "b", "c"])) == "c"
    import hashlib

    assert one(spark, hash_shard(F.lit("id-1"), 7)) == int(hashlib.md5(b"id-1").hexdigest()[:8], 16) % 7


@pytest.mark.parametrize("rows, shards", [(10, 3), (3, 5), (1, 1), (100, 7), (0, 4)])
def test_block_shards_match_contiguous_slices(spark, rows, shards):
    got = [r.s for r in spark.range(rows).orderBy("id").select(block_shard("id", rows, shards).alias("s")).collect()]
    small, longer = divmod(rows, shards)
    assert got == [s for s in range(shards) for _ in range(small + (s < longer))]


def test_shard_bounds():
    check_shard(None, None)
    check_shard(0, 1)
    for shard, num in ((0, None), (2, 2), (-1, 2)):
        with pytest.raises(ValueError):
            check_shard(shard, num)
    assert check_shards([2, 0, 2], 3) == [0, 2]
    with pytest.raises(ValueError, match=r"\[3\]"):
        check_shards([0, 3], 3)
