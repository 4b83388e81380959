"""The backtracking encoder against the tokenizer library."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer as Library

from inkwell.llm import bpe
from inkwell.llm.words import runs

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    with open(PATH, encoding="utf-8") as source:
        return bpe.Tokenizer(source.read()), Library.from_file(PATH)


def encoded(tokenizer, texts):
    out = []
    for _, _, data, offsets in runs(pa.array(texts), 1000):
        ids, places = tokenizer.encode_run(data, offsets)
        out += [ids[a:b].tolist() for a, b in zip(places[:-1], places[1:], strict=True)]
    return out


def test_random_texts(both):
    rng = random.Random(2)
    letters = [*"abcstrevldm'' ’  \n\t0123.,;!é漢ñ\u00a0\u3000\r☃\x1c\x85", "'s", "'ll", "<|endoftext|>", "the ", "<|end", "'re"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    assert encoded(both[0], texts) == [e.ids for e in both[1].encode_batch(texts, add_special_tokens=False)]


def test_every_token_and_long_pieces(both):
    texts = [both[1].decode([i]) for i in range(0, 50257, 7)] + ["a" * 5000, "ab" * 3000, " " * 700, "!" * 900]
    assert encoded(both[0], texts) == [e.ids for e in both[1].encode_batch(texts, add_special_tokens=False)]


def test_special_token_between_texts(both):
    texts = ["<|endof", "text|>", "x<|endoftext|><|endoftext|>y"]
    assert encoded(both[0], texts) == [e.ids for e in both[1].encode_batch(texts, add_special_tokens=False)]


def test_frames(spark):
    df = spark.createDataFrame([(1, "Hello  world\n"), (2, None), (3, "")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in bpe.decode(bpe.encode(df, PATH), PATH).collect()}
    assert rows[1]["decoded"] == "Hello  world\n" and rows[2]["ids"] == [] and rows[3]["decoded"] == ""
    ids = spark.createDataFrame([([99999999, -1, 15496],), ([165],), (None,)], "ids array<int>")
    assert [r["decoded"] for r in bpe.decode(ids, PATH).collect()] == ["Hello", "\ufffd", ""]
    assert bpe.round_trip(df.limit(0), PATH).count() == 0
