"""Collocations: the phrases of every language whose words occur together far more often than apart.

A phrase is 2 to 5 words of one piece of text, at least `LEAST` times in its language. Its score is that of
its weakest cut, `floor(1000 * a * n / (l * r))`. A phrase that stands, with every occurrence, inside one longer
phrase is dropped.

Best-first growth: every phrase that begins with a word w scores at most `floor(1000 * n / f(w))`, as the rest
of it occurs no less than the phrase. Words are the frontier, in the order of that bound. A round takes the best
words of every language, grows the phrases that begin with them word by word from frequent prefixes,
scores them and takes the score of the last phrase that would be returned as the language's threshold. The search ends when no
word is left whose bound reaches its threshold; equal bounds are still expanded, so ties are settled.

Texts are tokenized twice: to count words by their text, and to write what is left of the texts as
64-bit word hashes, with a zero wherever a piece ends or an infrequent word stands. Rounds scan that table.
What a scan looks for reaches it as a bit field of a fixed size (`BITS`): false hits cost a row and are removed by
exact joins. Counts are added up in the scan before they are shuffled. Phrases are told apart by 64-bit hashes of
their words' hashes, which include the language.

Defined cases: a null text is empty; a null language is `und`, together with rows that say so; repeated rows count each
time; an empty table, or one without frequent phrases, gives no rows. Only text and language are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm.words import LOWER_PLUS_ONE, as_signed, mix, prefix_sums, range_hash, runs
from inkwell.session import materialize
from inkwell.sources.shipping import ship_package

LONGEST = 5
LEAST = 100
TOP = 2000
BITS = 25
SHARES = (8, 1)  # a round expands words with this part of a language's occurrences, the last one all that can matter
RUN_BYTES = 1 << 20

_PIECE_END = np.zeros(256, dtype=bool)
_PIECE_END[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
_OUTSIDE = _PIECE_END.copy()
_OUTSIDE[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_STEP = np.uint64(0xD6E8FEB86659FD93)


def language_of(lang: Column) -> Column:
    return F.coalesce(lang, F.lit("und"))


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every word of a run, and whether it begins a piece."""
    inside = ~_OUTSIDE[data]
    edges = np.zeros(len(data) + 1, dtype=bool)  # between bytes: a word begins or ends, or a text does
    edges[1:-1] = inside[1:] != inside[:-1]
    edges[offsets] = True
    cuts = np.flatnonzero(edges)
    start, end = cuts[:-1], cuts[1:]
    words = inside[start] if len(start) else np.zeros(0, dtype=bool)
    start, end = start[words], end[words]
    text = np.searchsorted(offsets, start, "right") - 1
    ends = np.concatenate([[0], np.cumsum(_PIECE_END[data], dtype=np.int32)])
    piece = ends[start]
    first = np.ones(len(start), dtype=bool)
    first[1:] = (text[1:] != text[:-1]) | (piece[1:] != piece[:-1])
    return start, end, text, first


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Hashes of words of a language; never zero."""
    plain = range_hash(prefix_sums(LOWER_PLUS_ONE[data]), start, end)
    return mix(plain ^ seed) | np.uint64(1)


def seeds(languages: list[str | None]) -> np.ndarray:
    """One number for each language name."""
    out = np.zeros(len(languages), dtype=np.uint64)
    known: dict[str, int] = {}
    for i, name in enumerate(languages):
        if name not in known:
            raw = np.frombuffer((name or "und").encode() + b"\0", dtype=np.uint8)
            known[name] = int(range_hash(prefix_sums(raw.astype(np.uint64) + np.uint64(1)), np.array([0]), np.array([len(raw)]))[0])
        out[i] = known[name]
    return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, w, c): the distinct words of every run with their counts."""
    for batch in batches:
        languages = batch.column(0).to_pylist()
        seed = seeds(languages)
        for lo, _, data, offsets in runs(batch.column(1), RUN_BYTES):
            start, end, text, _ = _pieces(data, offsets)
            if not len(start):
                continue
            hashed = _word_hashes(data, start, end, seed[lo + text])
            distinct, one, count = np.unique(hashed, return_index=True, return_counts=True)
            length = end[one] - start[one]
            ends = np.cumsum(length)
            at = np.repeat(start[one] - ends + length, length) + np.arange(int(ends[-1]))
            spelled = _LOWER[data[at]]
            borders = np.concatenate([[0], ends]).astype(np.int32)
            word = pa.StringArray.from_buffers(len(one), pa.py_buffer(borders), pa.py_buffer(spelled))
            lang = pa.array([languages[lo + t] for t in text[one].tolist()], type=pa.string())
            yield pa.record_batch(
                [lang, word, pa.array(as_signed(distinct)), pa.array(count.astype(np.int64))],
                names=["lang", "word", "w", "c"],
            )


def _slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _has(field: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    slot = _slots(hashes, bits)
    return (field[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def bit_field(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """Bits set for the hashes of a table, gathered 64 at a time; at most 2 ** (bits - 6) rows come back."""
    slot = F.shiftrightunsigned(F.col(column), 64 - bits)
    rows = hashes.select(F.shiftright(slot, 6).alias("at"), slot.bitwiseAND(63).cast("int").alias("bit"))
    found = rows.groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("set")).toArrow()
    field = np.zeros(1 << (bits - 6), dtype=np.int64)
    field[found.column("at").to_numpy()] = found.column("set").to_numpy()
    return field.view(np.uint8)


class _Tokens:
    """The written hashes of runs, and phrases over them."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def phrases(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where n words of one piece begin, and the hashes of those phrases."""
        words = self.words
        count = len(words) - n + 1
        if count <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        whole = words[:count] != 0
        for j in range(1, n):
            whole &= words[j : j + count] != 0
        at = np.flatnonzero(whole)
        return at, phrase_hash([words[at + j] for j in range(n)])


def phrase_hash(words: list[np.ndarray]) -> np.ndarray:
    """Hash of phrases from the hashes of their words, one array for each place."""
    out = np.zeros(len(words[0]), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for word in words:
            out = mix((out + word) * _STEP)
    return out


def _token_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[_Tokens]:
    for batch in batches:
        for blob in batch.column(0):
            yield _Tokens(np.frombuffer(blob.as_buffer(), dtype=np.uint64))


def write_tokens(texts: DataFrame, frequent, bits: int) -> DataFrame:
    """Runs of texts as word hashes; zeros part pieces and stand for words that are not frequent."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seed = seeds(batch.column(0).to_pylist())
            for lo, _, data, offsets in runs(batch.column(1), RUN_BYTES):
                start, end, text, first = _pieces(data, offsets)
                if not len(start):
                    continue
                words = _word_hashes(data, start, end, seed[lo + text])
                words[~_has(frequent.value, words, bits)] = 0
                place = np.arange(len(words)) + np.cumsum(first)
                spread = np.zeros(int(place[-1]) + 2, dtype=np.uint64)
                spread[place] = words
                keep = spread != 0
                keep[1:] |= keep[:-1]  # of several zeros in a row the first one stays
                keep[0] = True
                yield pa.record_batch([pa.array([spread[keep].tobytes()], type=pa.binary())], names=["words"])

    return materialize(texts.mapInArrow(packed, "words binary"), "collocation-words")


def _grow(tokens: DataFrame, prefixes, n: int, bits: int) -> DataFrame:
    """(p, w, h, c): phrases of n words whose first n - 1 are among `prefixes`, counted by run."""

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _token_runs(batches):
            at, prefix = run.phrases(n - 1)
            follows = at + n - 1 < len(run.words)
            at, prefix = at[follows], prefix[follows]
            hit = _has(prefixes.value, prefix, bits) & (run.words[at + n - 1] != 0)
            prefix, last = prefix[hit], run.words[at[hit] + n - 1]
            with np.errstate(over="ignore"):
                whole = mix((prefix + last) * _STEP)
            distinct, one, count = np.unique(whole, return_index=True, return_counts=True)
            yield pa.record_batch(
                [pa.array(as_signed(x)) for x in (prefix[one], last[one], distinct, count.astype(np.uint64))],
                names=["p", "w", "h", "c"],
            )

    found = tokens.mapInArrow(grown, "p bigint, w bigint, h bigint, c bigint")
    return found.groupBy("p", "w", "h").agg(F.sum("c").alias("f"))


_SEEN = "h bigint, c bigint, left_least bigint, left_most bigint, right_least bigint, right_most bigint"


def _look(tokens: DataFrame, wanted, longest: int, bits: int) -> DataFrame:
    """Counts of the wanted phrases, and whether one and the same word always stands before or after them.

    A word that is not frequent, and the end of a piece, count as the word zero.
    """

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _token_runs(batches):
            around = np.concatenate([[np.uint64(0)], run.words, [np.uint64(0)]])
            for n in range(2, longest):
                at, h = run.phrases(n)
                hit = _has(wanted.value, h, bits)
                at, h = at[hit], h[hit]
                order = np.argsort(h, kind="stable")
                at, h = at[order], h[order]
                begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
                count = np.diff(np.append(begin, len(h)))
                columns = [as_signed(h[begin]), count.astype(np.int64)]
                for word in (as_signed(around[at]), as_signed(around[at + n + 1])):
                    columns += [
                        f.reduceat(word, begin) if len(begin) else word for f in (np.minimum, np.maximum)
                    ]
                yield pa.record_batch([pa.array(c) for c in columns], names=[x.split()[0] for x in _SEEN.split(", ")])

    folded = [F.min(c) if "least" in c else F.max(c) for c in ("left_least", "left_most", "right_least", "right_most")]
    found = tokens.mapInArrow(seen, _SEEN).groupBy("h").agg(F.sum("c").alias("f"), *folded)
    left, right = F.col("min(left_least)"), F.col("min(right_least)")
    inside = ((left == F.col("max(left_most)")) & (left != 0)) | ((right == F.col("max(right_most)")) & (right != 0))
    return found.select("h", "f", inside.alias("inside"))


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, k, lh, rh) from (h, words): every cut of a phrase with the hashes of both parts."""
    for batch in batches:
        h, words = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        sized: dict[int, list[int]] = {}
        for i, listed in enumerate(words):
            sized.setdefault(len(listed), []).append(i)
        for n, at in sized.items():
            table = np.array([words[i] for i in at], dtype=np.int64).view(np.uint64)
            own = np.array([h[i] for i in at], dtype=np.int64)
            for k in range(1, n):
                parts = [phrase_hash(list(table[:, a:b].T)) for a, b in ((0, k), (k, n))]
                yield pa.record_batch(
                    [pa.array(own), pa.array(np.full(len(own), k, dtype=np.int32)), *[pa.array(as_signed(p)) for p in parts]],
                    names=["h", "k", "lh", "rh"],
                )


def _big(value: Column) -> Column:
    return value.cast("decimal(38,0)")


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (l * r)); products have up to 38 digits, the result is at most 1000 * n."""
    small = [x.cast("decimal(19,0)") for x in (a, n, left, right)]
    above = _big(_big(small[0] * small[1]) * F.lit(1000).cast("decimal(4,0)"))
    over = _big(small[2] * small[3])
    rest = above % over
    return ((above - rest) / over).cast("bigint")


class _Search:
    """One search: the written tokens, the counted words, and what the rounds have found."""

    def __init__(self, docs: DataFrame, least: int, top: int, bits: int, longest: int):
        self.spark: SparkSession = docs.sparkSession
        ship_package(self.spark)
        self.least, self.top, self.bits, self.longest = least, top, bits, longest
        texts = docs.select(language_of(docs["lang"]).alias("lang"), F.coalesce(docs["text"], F.lit("")).alias("text"))
        counted = texts.mapInArrow(_count_words, "lang string, word string, w bigint, c bigint")
        counted = counted.groupBy("lang", "word").agg(F.min("w").alias("w"), F.sum("c").alias("f"))
        counted = materialize(counted, "collocation-counts")
        self.totals = materialize(counted.groupBy("lang").agg(F.sum("f").alias("n")), "collocation-totals")
        frequent = counted.where(F.col("f") >= least).join(self.totals, "lang")
        hashed = frequent.mapInArrow(_with_phrase_hash, "lang string, word string, w bigint, f bigint, n bigint, h bigint")
        self.words = materialize(hashed.withColumn("bound", F.expr("1000 * n div f")), "collocation-vocabulary")
        shared = self._sent(self.words, "w")
        self.tokens = write_tokens(texts, shared, bits)
        shared.destroy()

    def _sent(self, hashes: DataFrame, column: str):
        return self.spark.sparkContext.broadcast(bit_field(hashes, column, self.bits))

    def frontier(self, share: int) -> DataFrame:
        """Words with their place in the order of bounds: `before` counts the occurrences of better words, by bins of counts."""
        binned = self.words.withColumn("bin", F.floor(F.log2("f") * 8).cast("int"))
        bins = binned.groupBy("lang", "bin").agg(F.sum("f").alias("all"))
        order = Window.partitionBy("lang").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.select("lang", F.col("bin").alias("b"), F.coalesce(F.sum("all").over(order), F.lit(0)).alias("before"))
        placed = binned.join(bins.withColumnRenamed("lang", "l"), F.expr("lang = l AND bin = b"))
        return placed.where(F.col("before") * share < F.col("n")).select("lang", "h", "bound")

    def grow(self, first: DataFrame) -> DataFrame:
        """All phrases of at least `least` occurrences that begin with one of the words: (lang, n, words, h, p, w, f)."""
        known = self.words.select("lang", "n", "h", F.array("w").alias("words")).join(first.select("h"), "h", "left_semi")
        levels = []
        for size in range(2, self.longest + 1):
            shared = self._sent(known, "h")
            counts = _grow(self.tokens, shared, size, self.bits).where(F.col("f") >= self.least)
            before = known.select("lang", "n", F.col("h").alias("p"), F.col("words").alias("start"))
            longer = counts.join(before, "p").select(
                "lang", "n", F.concat("start", F.array("w")).alias("words"), "h", "p", "w", "f"
            )
            known = materialize(longer, f"collocation-{size}")
            shared.destroy()
            levels.append(known)
            if known.isEmpty():
                break
        out = levels[0]
        for level in levels[1:]:
            out = out.unionByName(level)
        return out

    def score(self, grown: DataFrame, least_score: DataFrame | None) -> DataFrame:
        """Surviving phrases with a, l, r and score."""
        worth = grown
        if least_score is not None:  # the cut before the last word is known already, and the score is no higher
            single = self.words.select(F.col("w"), F.col("f").alias("last_f"))
            starts = self.words.select(F.col("h").alias("p"), "f").unionByName(grown.select(F.col("h").alias("p"), "f"))
            worth = grown.join(single, "w").join(starts.withColumnRenamed("f", "start_f"), "p").join(least_score, "lang", "left")
            bound = _score(F.col("f"), F.col("n"), F.col("start_f"), F.col("last_f"))
            worth = worth.where(bound >= F.coalesce("threshold", F.lit(0)))
        worth = materialize(worth.select("lang", "n", "words", "h", "f"), "collocation-worth")
        cuts = materialize(worth.select("h", "words").mapInArrow(_cuts, "h bigint, k int, lh bigint, rh bigint"), "collocation-cuts")
        asked = cuts.select(F.col("rh").alias("h")).unionByName(worth.select("h")).distinct()
        shared = self._sent(asked, "h")
        seen = _look(self.tokens, shared, self.longest, self.bits).join(asked, "h", "left_semi")
        seen = materialize(seen, "collocation-seen")
        shared.destroy()
        counts = self.words.select("h", "f").unionByName(grown.select("h", "f")).unionByName(seen.select("h", "f"))
        counts = materialize(counts.groupBy("h").agg(F.max("f").alias("f")), "collocation-known")
        alive = worth.join(seen.where("inside").select("h"), "h", "left_anti")
        lefts, rights = (counts.select(F.col("h").alias(c + "h"), F.col("f").alias(c)) for c in "lr")
        cut = cuts.join(alive.select("h", "n", F.col("f").alias("a")), "h").join(lefts, "lh").join(rights, "rh")
        score = _score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("score")
        best = cut.groupBy("h").agg(F.min(F.struct(score, "k", "l", "r")).alias("best"))
        scored = alive.join(best, "h").select(
            "lang", "n", "words", "h", F.col("f").alias("a"), "best.l", "best.r", "best.score"
        )
        return self._first(scored)

    def _first(self, scored: DataFrame) -> DataFrame:
        """The first phrases of every language, with all that tie with the last of them."""
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
        return scored.withColumn("place", F.rank().over(order)).where(F.col("place") <= self.top).drop("place")

    def run(self) -> DataFrame:
        found, expanded, threshold = None, None, None
        for share in SHARES:
            batch = self.frontier(share)
            if expanded is not None:
                batch = batch.join(expanded.select("h"), "h", "left_anti").join(threshold, "lang", "left")
                batch = batch.where(F.col("bound") >= F.coalesce("threshold", F.lit(0))).select("lang", "h", "bound")
            batch = materialize(batch, "collocation-frontier")
            if batch.isEmpty():
                continue
            new = self.score(self.grow(batch), threshold)
            found = materialize(new if found is None else self._first(found.unionByName(new)), "collocation-found")
            expanded = batch if expanded is None else expanded.unionByName(batch)
            reached = found.groupBy("lang").agg(F.count("*").alias("rows"), F.min("score").alias("threshold"))
            threshold = materialize(reached.where(F.col("rows") >= self.top).select("lang", "threshold"), "collocation-threshold")
        return self._named(found)

    def _named(self, found: DataFrame | None) -> DataFrame:
        if found is None:
            names = "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint"
            return self.spark.createDataFrame([], names)
        placed = found.select("lang", "h", "a", "l", "r", "n", "score", F.posexplode("words").alias("at", "w"))
        spelled = placed.join(self.words.select("w", "word"), "w").groupBy("lang", "h", "a", "l", "r", "n", "score").agg(
            F.sort_array(F.collect_list(F.struct("at", "word"))).alias("spelled")
        )
        phrase = F.array_join(F.col("spelled.word"), " ")
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = spelled.withColumn("phrase", phrase).withColumn("rank", F.row_number().over(order).cast("bigint"))
        return ranked.where(F.col("rank") <= self.top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _with_phrase_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their hash as phrases of one word."""
    for batch in batches:
        w = batch.column(batch.schema.get_field_index("w")).to_numpy(zero_copy_only=False).view(np.uint64)
        columns = {name: batch.column(batch.schema.get_field_index(name)) for name in ("lang", "word", "w", "f", "n")}
        yield pa.record_batch([*columns.values(), pa.array(as_signed(phrase_hash([w])))], names=[*columns, "h"])


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP, bits: int = BITS, longest: int = LONGEST) -> DataFrame:
    """The first `top` phrases of every language: lang, rank, phrase, a, l, r, n, score."""
    return _Search(docs, least, top, bits, longest).run()
