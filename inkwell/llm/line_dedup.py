"""Near-equal lines across documents: a deletion-neighbourhood join that keeps the earliest.

Lines are compared by their words, A-Z in lower case. Two lines match when one word of one was changed,
added or left out against the other (edit distance of at most one word). A line emits itself and
all its variants with one word left out, as hashed keys; a changed word gives equal variants at the
same place, an added word makes a variant of one line equal to the other line. What meets in a
key is verified on the words themselves. Lines of fewer than `MIN_WORDS` words are never compared.

A line is dropped if a matching line stands earlier (by document id, then place in the document).
Lines that cannot match are told apart first: a single edit leaves one half of a line as it was, so
only lines that share a half with another line emit variants. All keys are pre-aggregated: a
key needs its earliest line only, so a passage in a third of all documents is one row per task.

Defined cases: a null text stays null; an empty text has no lines to compare; empty and blank lines stay;
line ends are `\\n` alone; a document whose lines all go has an empty text; a null id comes first; rows that share an id, or
have none, are documents of their own, in an order that their places in the files decide, equal rows included: the later ones
lose what the first one keeps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.words import as_signed, mix, powers, prefix_sums, range_hash, runs, words_of
from inkwell.session import materialize
from inkwell.sources.shipping import ship_package

MIN_WORDS = 8
LINE_BYTE = 0x0A
_WHOLE, _CHANGED = np.uint64(0x1B873593), np.uint64(0xCC9E2D51)
_LEAST = -(2**63)


def _line_spans(data: np.ndarray, offsets: np.ndarray):
    """Text and number in its text of each line, and the words of the run cut at lines."""
    breaks = np.flatnonzero(data == LINE_BYTE)
    # a line begins at each text and after each break inside it
    text_of_break = np.searchsorted(offsets, breaks, "right") - 1
    line_text = np.concatenate([np.arange(len(offsets) - 1), text_of_break])
    line_start = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((line_start, line_text))
    line_text, line_start = line_text[order], line_start[order]
    first = np.searchsorted(line_text, np.arange(len(offsets)))
    number = np.arange(len(line_text)) - first[line_text]
    words = words_of(data, offsets)
    word_first = np.append(np.searchsorted(words.start, line_start, "left"), len(words))
    return line_text, number, words, word_first


def _rows_of_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, content, line, number, size, halves) of every line that is long enough."""
    for batch in batches:
        for lo, hi, data, offsets in runs(batch.column(2)):
            text, number, words, first = _line_spans(data, offsets)
            size = np.diff(first)
            at = np.flatnonzero(size >= MIN_WORDS)
            start, end, n = first[at], first[at + 1], size[at]
            sums = prefix_sums(words.hash)
            halves = []
            for shorter in (n, n - 1):  # as the shorter line of a pair, and as the longer one
                half = shorter // 2
                salt = mix(shorter.astype(np.uint64))
                halves.append(mix(range_hash(sums, start, start + half) + salt))
                halves.append(mix(range_hash(sums, end - (shorter - half), end) ^ salt))
            stacked = np.stack([as_signed(h) for h in halves], axis=1)
            offsets_4 = pa.array(np.arange(0, 4 * len(at) + 1, 4, dtype=np.int32))
            yield pa.record_batch(
                [
                    batch.column(0).take(pa.array(lo + text[at])),
                    batch.column(1).take(pa.array(lo + text[at])),
                    pa.array(as_signed(range_hash(sums, start, end))),
                    pa.array(number[at].astype(np.int32)),
                    pa.ListArray.from_arrays(offsets_4, pa.array(stacked.ravel())),
                ],
                names=["key", "content", "line", "number", "halves"],
            )


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(line, variant, kind, words) of the lines asked for, from (numbers, text).

    Kind 0 leaves a word out and keeps its place, kind 1 forgets the place, kind 2 is the whole line.
    """
    base = 0x9E3779B97F4A7C15
    for batch in batches:
        for lo, hi, data, offsets in runs(batch.column(1)):
            text, _, words, first = _line_spans(data, offsets)
            asked = batch.column(0).slice(lo, hi - lo)
            counts = asked.value_lengths().to_numpy().astype(np.int64)
            listed = asked.flatten().to_numpy()
            kept_half = listed % 4  # 1: the first half, 2: the second, as some other line has it
            pick = np.searchsorted(text, np.repeat(np.arange(hi - lo), counts)) + listed // 4
            start, end = first[pick], first[pick + 1]
            n = end - start
            sums = prefix_sums(words.hash)
            line = range_hash(sums, start, end)
            owner = np.repeat(np.arange(len(pick)), n)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            # the edit is not in a half that is shared; the middle counts as both
            middle, half = (n - 1)[owner] // 2, kept_half[owner]
            possible = ((half & 1) > 0) & (place >= middle) | ((half & 2) > 0) & (place <= middle + 2)
            owner, place = owner[possible], place[possible]
            s, e, p = start[owner], end[owner], start[owner] + place
            # the sum without word p, with the words behind it one place further left
            back = powers(pow(base, -1, 1 << 64), len(sums) + 1)
            without = mix((sums[p] - sums[s]) * back[s] + (sums[e] - sums[p + 1]) * back[s + 1])
            changed = mix(without ^ mix(place.astype(np.uint64) + _CHANGED))
            columns = [
                pa.array(as_signed(np.concatenate([line[owner], line[owner], line]))),
                pa.array(as_signed(np.concatenate([changed, mix(without ^ _WHOLE), mix(line ^ _WHOLE)]))),
                pa.array(np.repeat(np.arange(3, dtype=np.int8), [len(owner), len(owner), len(pick)])),
            ]
            lists = np.concatenate([np.zeros(2 * len(owner), dtype=np.int64), n])
            offsets_all = pa.array(np.concatenate([[0], np.cumsum(lists)]).astype(np.int32))
            before = np.cumsum(n) - n
            values = words.hash[np.repeat(start - before, n) + np.arange(int(n.sum()))]
            columns.append(pa.ListArray.from_arrays(offsets_all, pa.array(as_signed(values))))
            yield pa.record_batch(columns, names=["line", "variant", "kind", "words"])


def _sent(rows: DataFrame, small: int) -> DataFrame:
    """A stored table, sent to every executor if it has at most `small` rows, else joined by a shuffle."""
    return F.broadcast(rows) if rows.count() <= small else rows


def within_one_word(a: pa.Array, b: pa.Array) -> pa.Array:
    """Whether one word changed, added or left out turns one list of words into the other."""
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = x.values.to_numpy(), y.values.to_numpy()
        shorter = min(len(x), len(y))
        if abs(len(x) - len(y)) > 1:
            out.append(False)
            continue
        differ = np.flatnonzero(x[:shorter] != y[:shorter])
        head = int(differ[0]) if len(differ) else shorter
        same = x[len(x) - shorter :] == y[len(y) - shorter :]
        wrong = np.flatnonzero(~same)
        tail = shorter - 1 - int(wrong[-1]) if len(wrong) else shorter
        out.append(head + tail >= max(len(x), len(y)) - 1)
    return pa.array(out, type=pa.bool_())


def duplicate_lines(docs: DataFrame, small: int = 1_000_000) -> DataFrame:
    """(key, content, dropped): numbers of the lines that go, of each document that loses any.

    `docs` has (key, content, text). `small`: key lists of up to so many rows (8 MB of hashes) are sent to every
    executor; longer ones are joined by a shuffle.
    """
    ship_package(docs.sparkSession)
    lines = materialize(
        docs.select("key", "content", "text").mapInArrow(
            _rows_of_lines, "key bigint, content bigint, line bigint, number int, halves array<bigint>"
        ),
        "lines",
    )
    place = F.struct("key", "content", "number")
    earliest = materialize(lines.groupBy("line").agg(F.min(place).alias("at")), "line-places")
    # lines that share a half with another line, and which half
    halves = lines.select("line", F.posexplode("halves").alias("which", "half"))
    shared = materialize(
        halves.groupBy("half").agg(F.min("line").alias("low"), F.max("line").alias("high")).where("low != high")
        .select("half"),
        "line-halves",
    )
    bit = F.when(F.col("which") % 2 == 0, 1).otherwise(2)
    candidates = materialize(
        halves.join(_sent(shared, small), "half")
        .groupBy("line")
        .agg(F.bit_or(bit).alias("kept"))
        .join(earliest, "line"),
        "line-candidates",
    )
    asked = candidates.groupBy(F.col("at.key").alias("key"), F.col("at.content").alias("content")).agg(
        F.sort_array(F.collect_set(F.col("at.number") * 4 + F.col("kept"))).alias("numbers")
    )
    emitted = materialize(
        docs.join(_sent(asked, small), ["key", "content"])
        .select("numbers", "text")
        .mapInArrow(_variants, "line bigint, variant bigint, kind tinyint, words array<bigint>"),
        "line-variants",
    )
    rows = emitted.select("line", "variant", "kind")
    meeting = materialize(
        rows.groupBy("variant").agg(F.min("line").alias("low"), F.max("line").alias("high")).where("low != high")
        .select("variant"),
        "line-meetings",
    )
    variants = rows.join(_sent(meeting, small), "variant").distinct().join(candidates.select("line", "at"), "line")
    at = F.struct("at.*", "line")
    variants = variants.withColumn("at", at)
    # Variants that lack a word at one place are within one edit of each other; a shortened line is within
    # one edit of the whole line that it equals, not of other shortened ones.
    first_of = variants.groupBy("variant").agg(
        *[F.min(F.when(F.col("kind") == k, F.col("at"))).alias(f"first_{k}") for k in range(3)],
    )
    before = F.when(F.col("kind") == 0, F.col("first_0")).when(F.col("kind") == 1, F.col("first_2")).otherwise(
        F.col("first_1")
    )
    met = (
        variants.join(first_of, "variant")
        .where(before < F.col("at"))
        .select("line", before["line"].alias("other"))
        .distinct()
    )
    words = emitted.where("kind = 2").groupBy("line").agg(F.any_value("words").alias("words"))
    mine, others = words.alias("m"), words.alias("o")
    near = (
        met.join(mine, met["line"] == F.col("m.line"))
        .join(others, F.col("other") == F.col("o.line"))
        .where(F.arrow_udf(within_one_word, "boolean")(F.col("m.words"), F.col("o.words")))
        .select(met["line"])
        .distinct()
    )
    dropped_lines = near.withColumn("near", F.lit(True))
    known = earliest.select("line", "at").join(dropped_lines, "line", "left")
    gone = (
        lines.select("key", "content", "number", "line")
        .join(known, "line")
        .where(F.col("near").isNotNull() | (F.struct("key", "content", "number") != F.col("at")))
    )
    return gone.groupBy("key", "content").agg(F.sort_array(F.collect_set("number")).alias("dropped"))


def with_row_key(docs: DataFrame, text: str, to: str) -> DataFrame:
    """`docs` with a number of every row: a hash of its text, its file and its place there, the same in every scan.

    A frame that no files stand behind is written first.
    """
    number = F.xxhash64("_metadata.file_path", "_metadata.row_index", docs[text])
    try:
        placed = docs.select("*", number.alias(to))
        placed.schema  # noqa: B018, resolves the columns
    except AnalysisException:
        return with_row_key(materialize(docs, "line-documents"), text, to)
    return placed


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with repeated lines taken out of `text`, and `dropped_lines`, how many went."""
    keyed = with_row_key(docs, text, "__content").withColumn(
        "__key", F.coalesce(F.col(doc_id).cast("bigint"), F.lit(_LEAST))
    )
    gone = duplicate_lines(
        keyed.select(
            F.col("__key").alias("key"), F.col("__content").alias("content"), F.coalesce(F.col(text), F.lit("")).alias("text")
        )
    ).select(F.col("key").alias("__k"), F.col("content").alias("__c"), F.col("dropped").alias("__dropped"))
    joined = keyed.join(gone, (F.col("__key") == F.col("__k")) & (F.col("__content") == F.col("__c")), "left")
    split = joined.withColumn("__lines", F.when(F.col("__dropped").isNotNull(), F.split(F.col(text), "\n")))
    kept = F.filter("__lines", lambda _, i: ~F.array_contains("__dropped", i.cast("int")))
    return (
        split.withColumns(
            {
                text: F.when(F.col("__dropped").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")),
                "dropped_lines": F.coalesce(F.size("__dropped"), F.lit(0)),
            }
        )
        .drop("__key", "__content", "__k", "__c", "__dropped", "__lines")
    )
