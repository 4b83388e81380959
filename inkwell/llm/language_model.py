"""Log-probabilities of texts under a log-bilinear model trained by noise-contrastive estimation.

Words are read as classes: the `TOP` most frequent training words and the end of a text are
classes of their own, other words fall into `BUCKETS` classes by their first letters. The model gives the class of
the next token from the two before it: a sum of their vectors, multiplied with the vectors of all classes. A
word within its class has its smoothed share of the class's training count, so that all
words, unknown ones too, have a probability and these add up to one.

Texts are read once into chunks of word numbers with a dictionary each, a written table. Counts
cover every training text: dictionary rows are summed by word and go back to their chunk. Every
task trains on all tokens of the training texts of its chunks from a common start, and parameters are averaged;
a first round before it warms up on one chunk in eight. The normaliser of all pairs of classes is one table, made by
batched matrix products.

Defined cases: a null or empty text is the end token alone; unknown words count 0; with no
training texts every score equals the base score; rows may repeat an id; a null id is learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.words import as_signed, mix, runs, words_of
from inkwell.session import materialize
from inkwell.sources.shipping import ship_package

TOP, BUCKETS, SIZE = 512, 512, 16
BATCH, NOISE, RATE = 4096, 128, 0.1
CHUNK_BYTES = 12 << 20
END = int(mix(np.array([0xE4D], dtype=np.uint64)).view(np.int64)[0])
_CHUNK = pa.schema(
    [("chunk", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_()))]
    + [(name, pa.binary()) for name in ("n_words", "words", "bucket", "trained", "tokens")]
)


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def chunk_texts(docs: DataFrame) -> DataFrame:
    """One row per chunk: its documents, a dictionary of word hashes, and all tokens as numbers in it."""

    def pack(number: int, parts: list[tuple]) -> pa.RecordBatch:
        ids = [i for p in parts for i in p[0]]
        held = [h for p in parts for h in p[1]]
        n_words = np.concatenate([p[2] for p in parts]).astype(np.int32)
        words, one, tokens = np.unique(np.concatenate([p[3] for p in parts]), return_index=True, return_inverse=True)
        bucket = np.concatenate([p[4] for p in parts])[one]
        learned = np.repeat(~np.array(held, dtype=bool), n_words)
        trained = np.bincount(tokens[learned], minlength=len(words)).astype(np.int32)
        values = [x.tobytes() for x in (n_words, words, bucket, trained, tokens.astype(np.int32))]
        return pa.record_batch(
            [pa.array([v], type=f.type) for v, f in zip([number, ids, held, *values], _CHUNK, strict=True)], schema=_CHUNK
        )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, held_bytes = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            ids, held = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi, data, offsets in runs(batch.column(2)):
                words = words_of(data, offsets)
                lead = data[words.start].astype(np.uint64)
                lead += (((lead >= 65) & (lead <= 90)) * 32).astype(np.uint64)
                second = np.where(words.end - words.start > 1, data[np.minimum(words.start + 1, max(0, len(data) - 1))], 0)
                bucket = (mix((lead << np.uint64(8)) + second.astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int16)
                parts.append((ids[lo:hi], held[lo:hi], np.diff(words.first), words.hash, bucket))
                held_bytes += len(data)
                if held_bytes >= CHUNK_BYTES:
                    yield pack(number, parts)
                    number, parts, held_bytes = number + 1, [], 0
        if parts:
            yield pack(number, parts)

    rows = docs.select(
        docs["doc_id"].cast("bigint").alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"), docs["text"]
    )
    schema = "chunk bigint, doc_id array<bigint>, held_out array<boolean>, " + ", ".join(
        f"{f.name} binary" for f in list(_CHUNK)[3:]
    )
    return materialize(rows.mapInArrow(read, schema), "lm-chunks")


def word_counts(chunks: DataFrame) -> DataFrame:
    """(chunk, place, word, bucket, count, first): training counts of all dictionary words.

    `first` marks one row per word. A word has one row per chunk at most.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, *raw in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                words = np.frombuffer(raw[0], dtype=np.uint64)
                columns = [
                    pa.array(np.full(len(words), chunk)),
                    pa.array(np.arange(len(words), dtype=np.int32)),
                    pa.array(as_signed(words)),
                    pa.array(np.frombuffer(raw[1], dtype=np.int16)),
                    pa.array(np.frombuffer(raw[2], dtype=np.int32)),
                ]
                yield pa.record_batch(columns, names=["chunk", "place", "word", "bucket", "trained"])

    rows = chunks.select("chunk", "words", "bucket", "trained").mapInArrow(
        spread, "chunk bigint, place int, word bigint, bucket smallint, trained int"
    )
    same = Window.partitionBy("word")
    counted = rows.select(
        "chunk", "place", "word", "bucket",
        F.sum("trained").over(same).alias("count"),
        (F.row_number().over(same.orderBy("chunk")) == 1).alias("first"),
    )
    return materialize(counted, "lm-counts")


@dataclass
class Statistics:
    """Training tokens and their distinct words, by class. Classes: top words, end, buckets."""

    tokens: int
    distinct: int
    ends: int
    top: np.ndarray  # hashes, ascending
    top_counts: np.ndarray
    bucket_tokens: np.ndarray
    bucket_words: np.ndarray

    @property
    def classes(self) -> int:
        return len(self.top) + 1 + BUCKETS

    def class_of(self, words: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        out = len(self.top) + 1 + buckets.astype(np.int64)
        if len(self.top) and len(words):
            at = np.minimum(np.searchsorted(self.top, words), len(self.top) - 1)
            out = np.where(self.top[at] == words, at, out)
        return out

    @property
    def shares(self) -> np.ndarray:
        counts = np.concatenate([self.top_counts, [self.ends], self.bucket_tokens]).astype(float) + 1
        return counts / counts.sum()

    def in_class(self, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 share of words within their class."""
        bucket = classes - len(self.top) - 1
        inside = bucket >= 0
        out = np.zeros(len(classes))
        b = bucket[inside]
        out[inside] = np.log10((counts[inside] + 1) / (self.bucket_tokens[b] + self.bucket_words[b] + 1))
        return out


def statistics(chunks: DataFrame, counts: DataFrame) -> Statistics:
    """Totals by class; at most TOP + BUCKETS rows come to the driver."""
    words = counts.where(F.col("first") & (F.col("count") > 0)).select("word", "bucket", "count")
    top = words.orderBy(F.desc("count"), "word").limit(TOP).collect()
    by_bucket = words.groupBy("bucket").agg(F.sum("count").alias("tokens"), F.count("*").alias("words")).collect()
    ends = chunks.select(F.size(F.filter("held_out", lambda h: ~h)).alias("n")).agg(F.sum("n")).first()[0] or 0
    tokens, distinct = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
    for row in by_bucket:
        tokens[row["bucket"]], distinct[row["bucket"]] = row["tokens"], row["words"]
    total, kinds = int(tokens.sum()) + ends, int(distinct.sum()) + (ends > 0)
    for row in top:
        tokens[row["bucket"]] -= row["count"]
        distinct[row["bucket"]] -= 1
    hashes = np.array([row["word"] for row in top], dtype=np.int64).view(np.uint64)
    order = np.argsort(hashes)
    top_counts = np.array([row["count"] for row in top], dtype=np.int64)[order]
    return Statistics(total, kinds, ends, hashes[order], top_counts, tokens, distinct)


class LogBilinear:
    """Class vectors: as target, as the token before, as the one before that; and a bias."""

    NAMES = ("target", "one", "two", "bias")

    def __init__(self, shares: np.ndarray, seed: int = 5):
        random = np.random.default_rng(seed)
        n = len(shares)
        self.target, self.one, self.two = (
            (random.standard_normal((n + extra, SIZE)) * 0.1).astype(np.float32) for extra in (0, 1, 1)
        )  # the last row of `one` and `two` stands before a text
        self.bias = np.log(shares).astype(np.float32)
        self.log_noise = np.log(shares).astype(np.float32)
        self.cumulative = np.cumsum(shares)

    def state(self) -> np.ndarray:
        return np.concatenate([getattr(self, name).ravel() for name in self.NAMES])

    def load(self, state: np.ndarray) -> None:
        place = 0
        for name in self.NAMES:
            value = getattr(self, name)
            setattr(self, name, state[place : place + value.size].reshape(value.shape).astype(np.float32).copy())
            place += value.size

    def start(self) -> None:
        self.squares = {name: np.full(getattr(self, name).shape, 1e-3, dtype=np.float32) for name in self.NAMES}

    def _step(self, name: str, gradient: np.ndarray, rows: np.ndarray) -> None:
        """Adagrad on the rows that a batch used."""
        value, squares = getattr(self, name), self.squares[name]
        if value.ndim == 1:
            total = np.bincount(rows, weights=gradient, minlength=len(value)).astype(np.float32)
        else:
            order = np.argsort(rows, kind="stable")
            kept, first = np.unique(rows[order], return_index=True)
            total = np.zeros_like(value)
            total[kept] = np.add.reduceat(gradient[order], first, axis=0)
        squares += total * total
        value -= RATE * total / np.sqrt(squares)

    def learn(self, target: np.ndarray, one: np.ndarray, two: np.ndarray, random: np.random.Generator) -> None:
        """One noise-contrastive step: tell targets from noise that the batch shares."""
        n = len(target)
        noise = np.minimum(np.searchsorted(self.cumulative, random.random(NOISE)), len(self.bias) - 1)
        q = self.one[one] + self.two[two]
        offset = np.float32(np.log(NOISE))
        true = np.einsum("nd,nd->n", q, self.target[target]) + self.bias[target] - self.log_noise[target] - offset
        false = q @ self.target[noise].T + (self.bias[noise] - self.log_noise[noise] - offset)
        d_true = (1 / (1 + np.exp(-true)) - 1) / n
        d_false = 1 / (1 + np.exp(-false)) / n
        d_q = d_true[:, None] * self.target[target] + d_false @ self.target[noise]
        rows = np.concatenate([target, noise])
        scale = np.float32(n ** 0.5)  # a common scale for batches of any size
        self._step("target", scale * np.concatenate([d_true[:, None] * q, d_false.T @ q]), rows)
        self._step("bias", scale * np.concatenate([d_true, d_false.sum(axis=0)]), rows)
        self._step("one", scale * d_q, one)
        self._step("two", scale * d_q, two)

    def normaliser(self) -> np.ndarray:
        """log of the sum over all classes, for every pair of classes before."""
        out = np.empty((len(self.one), len(self.two)), dtype=np.float32)
        for i in range(len(self.one)):
            scores = (self.one[i] + self.two) @ self.target.T + self.bias
            most = scores.max(axis=1)
            out[i] = most + np.log(np.exp(scores - most[:, None]).sum(axis=1))
        return out


def _streams(raw: tuple, stats: Statistics, counts: np.ndarray | None, learned: np.ndarray | None):
    """Classes of a chunk's texts with their ends and contexts, and places of its words in them."""
    n_words, words, bucket, tokens = (
        np.frombuffer(x, dtype=t) for x, t in zip(raw, (np.int32, np.uint64, np.int16, np.int32), strict=True)
    )
    classes = stats.class_of(words, bucket)
    length = n_words.astype(np.int64) + 1
    last = np.cumsum(length) - 1
    stream = np.full(int(length.sum()), len(stats.top), dtype=np.int64)
    is_word = np.ones(len(stream), dtype=bool)
    is_word[last] = False
    stream[is_word] = classes[tokens]
    before = stats.classes
    one, two = np.empty_like(stream), np.empty_like(stream)
    one[1:], two[2:] = stream[:-1], stream[:-2]
    first = last - length + 1
    one[first] = two[first] = before
    second = first[length > 1] + 1
    two[second] = before
    inside = None if counts is None else stats.in_class(classes, counts)[tokens]
    chosen = None if learned is None else np.repeat(learned, length)
    return stream, one, two, is_word, inside, length, tokens, chosen


def learn_chunk(model: LogBilinear, chunk: int, held: list[bool], raw: tuple, stats: Statistics) -> int:
    """Every training token of a chunk is a target once, in random order; returns their number."""
    random = np.random.default_rng(chunk + 1)
    stream, one, two, *_, chosen = _streams(raw, stats, None, ~np.array(held, dtype=bool))
    at = random.permutation(np.flatnonzero(chosen))
    for lo in range(0, len(at), BATCH):
        part = at[lo : lo + BATCH]
        model.learn(stream[part], one[part], two[part], random)
    return len(at)


def train(chunks: DataFrame, stats: Statistics, slots: int = 16) -> LogBilinear:
    """Train on all chunks and average; at most `slots` sums of parameters come to the driver."""
    model = LogBilinear(stats.shares)
    context = chunks.sparkSession.sparkContext

    def fit(shared):
        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine, seen = LogBilinear(stats.shares), 0
            mine.load(shared.value)
            mine.start()
            for batch in batches:
                for chunk, held, *raw in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
                    seen += learn_chunk(mine, chunk, held, tuple(raw), stats)
            if seen:
                state = (mine.state().astype(np.float64) * seen).tobytes()
                yield pa.record_batch([pa.array([float(seen)]), pa.array([state])], names=["weight", "state"])

        return learn

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, total = 0.0, None
        for batch in batches:
            for w, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                state = np.frombuffer(raw, dtype=np.float64)
                weight, total = weight + w, state if total is None else total + state
        if total is not None:
            yield pa.record_batch([pa.array([weight]), pa.array([total.tobytes()])], names=["weight", "state"])

    part = F.pmod(F.xxhash64("chunk"), F.lit(8)) == 0
    for some in (chunks.where(part), chunks):
        columns = some.select("chunk", "held_out", "n_words", "words", "bucket", "tokens")
        shared = context.broadcast(model.state())
        fitted = columns.mapInArrow(fit(shared), "weight double, state binary")
        sums = fitted.repartition(slots).mapInArrow(add, "weight double, state binary").collect()
        weight = sum(row["weight"] for row in sums)
        if weight:
            model.load(sum(np.frombuffer(row["state"], dtype=np.float64) for row in sums) / weight)
    return model


def score_documents(docs: DataFrame) -> DataFrame:
    """Base score and model score of every row of `docs` (doc_id, text)."""
    ship_package(docs.sparkSession)
    chunks = chunk_texts(docs)
    counts = word_counts(chunks)
    stats = statistics(chunks, counts)
    model = train(chunks, stats)
    shared = docs.sparkSession.sparkContext.broadcast((stats, model, model.normaliser()))
    schema = (
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
        "base_score double, score double"
    )

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        stats, model, normaliser = shared.value
        count = np.zeros(right.num_rows, dtype=np.int64)
        count[right.column("place").to_numpy()] = right.column("count").to_numpy()
        row = left.slice(0, 1)
        raw = tuple(row.column(c)[0].as_py() for c in ("n_words", "words", "bucket", "tokens"))
        stream, one, two, is_word, inside, length, tokens, _ = _streams(raw, stats, count, None)
        first = np.cumsum(length) - length
        base = np.log10(stats.ends + 1) * ~is_word
        base[is_word] = np.log10(count + 1)[tokens]
        base -= np.log10(stats.tokens + stats.distinct + 1)
        known = np.full(len(stream), stats.ends > 0)
        known[is_word] = (count > 0)[tokens]
        total = np.empty(len(stream))
        for lo in range(0, len(stream), 1 << 18):
            s, a, b = (x[lo : lo + (1 << 18)] for x in (stream, one, two))
            q = model.one[a] + model.two[b]
            total[lo : lo + len(s)] = np.einsum("nd,nd->n", q, model.target[s]) + model.bias[s] - normaliser[a, b]
        total /= np.log(10)
        total[is_word] += inside
        sums = [np.add.reduceat(x, first) for x in (known.astype(np.int64), base, total)]
        if not stats.tokens:
            sums[2] = sums[1]
        ids, held = row.column("doc_id")[0].values, row.column("held_out")[0].values
        constant = np.full(len(length), stats.tokens)
        return pa.table(
            [ids, held, pa.array(length), pa.array(sums[0]), pa.array(constant), pa.array(sums[1]), pa.array(sums[2])],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    texts = chunks.select("chunk", "doc_id", "held_out", "n_words", "words", "bucket", "tokens")
    return (
        texts.groupBy("chunk")
        .cogroup(counts.select("chunk", "place", "count").groupBy("chunk"))
        .applyInArrow(score, schema)
    )
