"""Toxicity of documents: a bidirectional gated recurrent network over overlapping windows.

A word enters as its own vector and as the mean of vectors of its character n-grams, so unseen
forms of a stem are known. Two gated recurrences read a window forwards and backwards; attention pools
their states into one logit. All overlapping windows of a text are scored; the largest logit,
calibrated, is the score. Training and scoring are numpy; Spark spreads the texts.

The network is fitted in one executor task on a bounded sample: `SAMPLE_TOXIC` toxic and `SAMPLE_CLEAN` clean documents,
the first by a hash of the id. Only the model (1.2 MB) comes to the driver. Which windows of a toxic document are toxic is not known: the best by the
current model are taken, at the start by word counts. A fifth of the sample is kept for calibration.

Defined cases: a null or empty text scores 0.0; ids labelled more than once take their largest
label, and of documents that share an id the first text is learned from; null labels are left out; with only one class in the labels every non-empty text gets its share.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.words import LOWER_PLUS_ONE, Words, prefix_sums, range_hash, runs, word_bytes, words_of
from inkwell.session import materialize
from inkwell.sources.shipping import ship_package

SAMPLE_TOXIC, SAMPLE_CLEAN = 1500, 3000
WINDOW, STRIDE, AT_ONCE = 32, 16, 2048
STEPS = 30  # of 256 windows each, a round; whatever the size of the sample
WORDS, GRAMS = 20_000, 1 << 14
SIZE, HIDDEN = 8, 8
THRESHOLD = 0.3
RUN_BYTES = 1 << 20


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


@dataclass
class Batch:
    """Distinct words of a run and its windows over them; the last distinct word is padding."""

    word: np.ndarray  # vocabulary row of each distinct word, WORDS if unknown
    gram: np.ndarray  # n-gram rows of all distinct words, one after the other
    grams: np.ndarray  # how many each has
    windows: np.ndarray  # (windows, WINDOW) places of distinct words
    text: np.ndarray  # text of each window


def batch_of(data: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray) -> Batch:
    """Distinct words, n-grams and windows of a run of texts. `vocabulary` is ascending."""
    words = words_of(data, offsets)
    distinct, one, which = np.unique(words.hash, return_index=True, return_inverse=True)
    word = np.full(len(distinct) + 1, WORDS, dtype=np.int64)
    if len(vocabulary) and len(distinct):
        at = np.minimum(np.searchsorted(vocabulary, distinct), len(vocabulary) - 1)
        known = vocabulary[at] == distinct
        word[:-1][known] = at[known]
    gram, grams = _grams(words, one)
    return Batch(word, gram, grams, *_windows(which.astype(np.int32), words.first, len(distinct)))


def _windows(which: np.ndarray, first: np.ndarray, padding: int) -> tuple[np.ndarray, np.ndarray]:
    """All overlapping windows of texts over distinct words, and the text of each."""
    length = np.diff(first)
    count = np.where(length > 0, 1 + np.maximum(0, -(-(length - WINDOW) // STRIDE)), 0)
    text = np.repeat(np.arange(len(length)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start, end = (first[text] + number * STRIDE).astype(np.int32), first[1:][text].astype(np.int32)
    windows = np.full((len(text), WINDOW), padding, dtype=np.int32)
    for t in range(WINDOW):
        inside = start + t < end
        windows[inside, t] = which[start[inside] + t]
    return windows, text


def _grams(words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the 3-, 4- and 5-byte pieces of the chosen words, with their borders."""
    length = words.end[at] - words.start[at] + 2
    first = np.cumsum(length) - length
    source = np.repeat(words.start[at] - 1 - first, length) + np.arange(int(length.sum()))
    border = np.zeros(len(source), dtype=bool)
    border[first] = True
    border[first + length - 1] = True
    values = np.where(border, np.uint64(1), LOWER_PLUS_ONE[words.data[np.clip(source, 0, max(0, len(words.data) - 1))]])
    sums = prefix_sums(values)
    owner = np.repeat(np.arange(len(at)), length)
    end = np.repeat(first + length, length)
    rows, owners = [], []
    for n in (3, 4, 5):
        place = np.flatnonzero(np.arange(len(source)) + n <= end)
        rows.append((range_hash(sums, place, place + n) >> np.uint64(50)).astype(np.int64))
        owners.append(owner[place])
    row, owned = np.concatenate(rows), np.concatenate(owners)
    order = np.argsort(owned, kind="stable")
    counts = np.append(np.bincount(owned, minlength=len(at)), 0)
    return row[order], counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _counts(batch: Batch) -> np.ndarray:
    return np.maximum(batch.grams, 1).astype(np.float32)[:, None]


class Network:
    """The parameters, and both passes through them."""

    def __init__(self, seed: int = 7):
        random = np.random.default_rng(seed)

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (random.standard_normal(shape) * scale).astype(np.float32)

        self.p = {
            "word": normal(WORDS + 1, SIZE, scale=0.1),
            "gram": normal(GRAMS, SIZE, scale=0.1),
            "attend": normal(2 * HIDDEN, HIDDEN, scale=0.3),
            "attend_v": normal(HIDDEN, scale=0.3),
            "out": normal(2 * HIDDEN, scale=0.3),
            "out_b": np.full(1, -1.0, dtype=np.float32),
        }
        for way in "fb":
            self.p[f"x_{way}"] = normal(2 * SIZE, 3 * HIDDEN, scale=0.4)
            self.p[f"h_{way}"] = normal(HIDDEN, 3 * HIDDEN, scale=0.3)
            self.p[f"bias_{way}"] = np.zeros(3 * HIDDEN, dtype=np.float32)
        self.p["word"][WORDS] = 0

    def inputs(self, batch: Batch) -> np.ndarray:
        """Vectors of the distinct words; zero for padding."""
        ends = np.cumsum(batch.grams)
        total = np.zeros((len(batch.grams), SIZE), dtype=np.float32)
        for lo in range(0, len(total), 1 << 14):
            grams = batch.grams[lo : lo + (1 << 14)]
            has = np.flatnonzero(grams)
            if len(has):
                begin = int(ends[lo] - grams[0])
                vectors = self.p["gram"][batch.gram[begin : int(ends[lo + len(grams) - 1])]]
                total[lo + has] = np.add.reduceat(vectors, (np.cumsum(grams) - grams)[has], axis=0)
        return np.concatenate([self.p["word"][batch.word], total / _counts(batch)], axis=1)

    def _read(self, gates: np.ndarray, windows: np.ndarray, mask: np.ndarray, way: str, keep: bool):
        n, u = len(windows), self.p[f"h_{way}"]
        state = np.zeros((n, HIDDEN), dtype=np.float32)
        states = np.empty((WINDOW, n, HIDDEN), dtype=np.float32)
        steps = range(WINDOW) if way == "f" else range(WINDOW - 1, -1, -1)
        kept = []
        for t in steps:
            x = gates[windows[:, t]]
            hu = state @ u
            zr = x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN]
            zr = _sigmoid(zr)
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            new = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            after = (new + z * (state - new)) * mask[:, t : t + 1]
            if keep:
                kept.append((t, state, z, r, new, hu[:, 2 * HIDDEN :]))
            states[t] = state = after
        return states, kept

    def logits(self, batch: Batch) -> np.ndarray:
        """Logits of all windows of a batch."""
        vectors = self.inputs(batch)
        gates = [vectors @ self.p[f"x_{w}"] + self.p[f"bias_{w}"] for w in "fb"]
        parts = [
            self.forward(batch, batch.windows[lo : lo + AT_ONCE], vectors=vectors, gates=gates)
            for lo in range(0, len(batch.windows), AT_ONCE)
        ]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.float32)

    def forward(self, batch: Batch, windows: np.ndarray, keep: bool = False, vectors=None, gates=None):
        """Logits of windows; with `keep`, also what the backward pass needs."""
        if gates is None:
            vectors = self.inputs(batch)
            gates = [vectors @ self.p[f"x_{w}"] + self.p[f"bias_{w}"] for w in "fb"]
        mask = (windows < len(batch.word) - 1).astype(np.float32)
        sides = [self._read(gate, windows, mask, way, keep) for gate, way in zip(gates, "fb", strict=True)]
        h = np.concatenate([sides[0][0], sides[1][0]], axis=2)  # (WINDOW, n, 2 HIDDEN)
        a = np.tanh(h @ self.p["attend"])
        scores = a @ self.p["attend_v"] + (mask.T - 1) * 1e4
        weight = np.exp(scores - scores.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, h)
        logits = pooled @ self.p["out"] + self.p["out_b"]
        return (logits, (vectors, mask, sides, h, a, weight, pooled)) if keep else logits

    def gradients(self, batch: Batch, windows: np.ndarray, labels: np.ndarray, weights: np.ndarray):
        logits, (vectors, mask, sides, h, a, weight, pooled) = self.forward(batch, windows, keep=True)
        g = {}
        d = ((_sigmoid(logits) - labels) * weights / len(labels)).astype(np.float32)
        g["out"], g["out_b"] = pooled.T @ d, d.sum(keepdims=True)
        d_pooled = d[:, None] * self.p["out"]
        d_h = weight[:, :, None] * d_pooled
        d_weight = np.einsum("tnh,nh->tn", h, d_pooled)
        d_scores = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["attend_v"] = np.einsum("tnk,tn->k", a, d_scores)
        d_a = d_scores[:, :, None] * self.p["attend_v"] * (1 - a * a)
        g["attend"] = np.einsum("tnh,tnk->hk", h, d_a)
        d_h += d_a @ self.p["attend"].T
        d_vectors = np.zeros_like(vectors)
        for side, way in enumerate("fb"):
            u, gates_grad = self.p[f"h_{way}"], np.zeros((len(vectors), 3 * HIDDEN), dtype=np.float32)
            g_u = np.zeros_like(u)
            back = np.zeros((len(windows), HIDDEN), dtype=np.float32)
            for t, state, z, r, new, hn in reversed(sides[side][1]):
                d_after = (back + d_h[t, :, side * HIDDEN : (side + 1) * HIDDEN]) * mask[:, t : t + 1]
                d_new = d_after * (1 - z) * (1 - new * new)
                d_z = d_after * (state - new) * z * (1 - z)
                d_r = d_new * hn * r * (1 - r)
                d_hu = np.concatenate([d_z, d_r, d_new * r], axis=1)
                g_u += state.T @ d_hu
                back = d_after * z + d_hu @ u.T
                np.add.at(gates_grad, windows[:, t], np.concatenate([d_z, d_r, d_new], axis=1))
            g[f"h_{way}"] = g_u
            g[f"bias_{way}"] = gates_grad.sum(axis=0)
            g[f"x_{way}"] = vectors.T @ gates_grad
            d_vectors += gates_grad @ self.p[f"x_{way}"].T
        g["word"] = np.zeros_like(self.p["word"])
        np.add.at(g["word"], batch.word, d_vectors[:, :SIZE])
        g["word"][WORDS] = 0
        g["gram"] = np.zeros_like(self.p["gram"])
        share = d_vectors[:, SIZE:] / _counts(batch)
        np.add.at(g["gram"], batch.gram, np.repeat(share, batch.grams, axis=0))
        return g


@dataclass
class Model:
    network: Network
    vocabulary: np.ndarray
    slope: float
    shift: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Score of each text, 0.0 where there are no words."""
        out = np.zeros(len(texts))
        for lo, hi, data, offsets in runs(texts, RUN_BYTES):
            best = self.best_logits(batch_of(data, offsets, self.vocabulary), hi - lo)
            found = best > -np.inf
            out[lo:hi][found] = _sigmoid(self.slope * best[found] + self.shift)
        return out

    def best_logits(self, batch: Batch, texts: int) -> np.ndarray:
        best = np.full(texts, -np.inf)
        if len(batch.windows):
            np.maximum.at(best, batch.text, self.network.logits(batch).astype(float))
        return best


def _surplus(toxic: np.ndarray, documents: np.ndarray, share: float) -> np.ndarray:
    """How far the number of toxic documents with a feature lies above chance, in deviations."""
    expected = share * documents
    return (toxic - expected) / np.sqrt(expected + 1)


def fit(texts: list[str] | pa.Array, labels: list[int], weights: tuple[float, float] = (1.0, 1.0), rounds: int = 8) -> Model:
    """Fit the network. `weights`: how many labelled rows a clean and a toxic sampled row stand for."""
    label = np.array(labels, dtype=np.int64)
    network = Network()
    share = weights[1] * label.sum() / max(1e-9, weights[1] * label.sum() + weights[0] * (1 - label).sum())
    hashes, lengths, spelled = [], [], {}
    column = texts if isinstance(texts, pa.Array) else pa.array(texts, type=pa.string())
    for _, _, data, offsets in runs(column, RUN_BYTES):
        words = words_of(data, offsets)
        hashes.append(words.hash)
        lengths.append(np.diff(words.first))
        distinct, one = np.unique(words.hash, return_index=True)
        new = [i for i, h in enumerate(distinct.tolist()) if h not in spelled]
        spelled |= zip(distinct[new].tolist(), word_bytes(words, one[new]), strict=True)
    if not spelled or label.min() == label.max():
        prior = float(np.clip(share if len(label) else 0.0, 1e-6, 1 - 1e-6))
        return Model(network, np.zeros(0, dtype=np.uint64), 0.0, float(np.log(prior / (1 - prior))))
    length = np.concatenate(lengths)
    distinct, which = np.unique(np.concatenate(hashes), return_inverse=True)
    del hashes
    text_of = np.repeat(np.arange(len(label)), length)
    pairs = np.unique(text_of * len(distinct) + which)  # a word counts once in a text
    in_text, in_word = pairs // len(distinct), pairs % len(distinct)
    documents = np.bincount(in_word, minlength=len(distinct))
    toxic = np.bincount(in_word, weights=label[in_text], minlength=len(distinct))
    common = np.sort(np.argsort(-documents, kind="stable")[:WORDS])
    vocabulary = distinct[common]  # ascending, as distinct is
    word = np.full(len(distinct) + 1, WORDS, dtype=np.int64)
    word[common] = np.arange(len(common))
    parts = []  # n-grams of the distinct words, some at a time
    for lo in range(0, len(distinct), 20_000):
        listed = b" ".join(spelled[h] for h in distinct[lo : lo + 20_000].tolist())
        some = words_of(np.frombuffer(listed, dtype=np.uint8), np.array([0, len(listed)]))
        gram, grams = _grams(some, np.arange(len(some)))
        parts.append((gram.astype(np.int32), grams[:-1]))
    del spelled
    grams = np.append(np.concatenate([p[1] for p in parts]), 0)
    windows, window_text = _windows(which.astype(np.int32), np.concatenate([[0], np.cumsum(length)]), len(distinct))
    batch = Batch(word, np.concatenate([p[0] for p in parts]), grams, windows, window_text)
    word_odds = _surplus(toxic, documents, label.mean())
    # n-grams tell stems apart when whole words are rare
    gram_owner = np.repeat(np.arange(len(batch.grams), dtype=np.int32), batch.grams)
    gram_toxic = np.bincount(batch.gram, weights=np.append(toxic, 0)[gram_owner], minlength=GRAMS)
    gram_documents = np.bincount(batch.gram, weights=np.append(documents, 0)[gram_owner], minlength=GRAMS)
    gram_odds = _surplus(gram_toxic, gram_documents, label.mean())
    word_gram = np.full(len(batch.grams), -9.0)
    np.maximum.at(word_gram, gram_owner, gram_odds[batch.gram])
    # vectors start from what the counts say
    network.p["word"][: len(common), 0] = np.clip(word_odds[common] / 4, -1, 2)
    network.p["gram"][:, 0] = np.clip(gram_odds / 4, -1, 2)
    del gram_owner, pairs, in_text, in_word
    start = np.append(word_odds, -9.0) + word_gram
    guess = start[batch.windows].max(axis=1)
    rng = np.random.default_rng(11)
    fold = rng.random(len(label)) < 0.2
    window_label, window_fold = label[batch.text], fold[batch.text]
    model = Model(network, vocabulary, 1.0, 0.0)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}
    step = 0
    for turn in range(rounds):
        if turn:
            guess = network.logits(batch)
        order = np.lexsort((-guess, batch.text))
        rank = np.empty(len(order), dtype=np.int64)
        begins = np.searchsorted(batch.text[order], batch.text[order], "left")
        rank[order] = np.arange(len(order)) - begins
        positive = np.flatnonzero((window_label == 1) & (rank < 1) & ~window_fold)
        clean = np.flatnonzero((window_label == 0) & ~window_fold)
        hard = clean[np.argsort(-guess[clean], kind="stable")[: max(64, len(positive))]]
        for _ in range(STEPS if len(positive) and len(clean) else 0):
            parts = ((positive, 64), (hard, 64), (clean, 128))
            at = np.concatenate([rng.choice(pool, size) for pool, size in parts])
            step += 1
            windows = batch.windows[at]
            local, inverse = np.unique(windows, return_inverse=True)
            small, windows = _part(batch, local, inverse.reshape(windows.shape))
            hidden = rng.random(len(small.word)) < 0.3  # some words by their characters only
            small.word = np.where(hidden, WORDS, small.word)
            grads = network.gradients(small, windows, window_label[at], np.ones(len(at), dtype=np.float32))
            rate = 0.01 if turn < rounds - 3 else 0.003
            slow = {"word": 0.2, "gram": 0.2}  # few windows see a word: its start counts for more
            for k, grad in grads.items():
                m, v = moments[k]
                m *= 0.9
                m += 0.1 * grad
                v *= 0.999
                v += 0.001 * grad * grad
                network.p[k] -= rate * slow.get(k, 1.0) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
    best = model.best_logits(batch, len(label))
    used = (best > -np.inf) & (fold if len(set(label[fold].tolist())) == 2 else True)
    model.slope, model.shift = _calibrate(best[used], label[used], np.where(label[used] == 1, weights[1], weights[0]))
    return model


def _part(batch: Batch, local: np.ndarray, windows: np.ndarray) -> tuple[Batch, np.ndarray]:
    """The part of a batch that some windows use; padding stays last."""
    padding = len(batch.word) - 1
    if not len(local) or local[-1] != padding:
        local = np.append(local, padding)
    first = np.cumsum(batch.grams) - batch.grams
    counts = batch.grams[local]
    before = np.cumsum(counts) - counts
    gram = batch.gram[np.repeat(first[local] - before, counts) + np.arange(int(counts.sum()))]
    return Batch(batch.word[local], gram, counts, windows, batch.text[:0]), windows


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one number, by Newton steps with a little shrinkage."""
    a, b = 1.0, 0.0
    weight = weight / weight.mean()
    for _ in range(50):
        p = _sigmoid(np.clip(a * x + b, -30, 30))
        d, w = weight * (p - y), weight * p * (1 - p)
        gradient = np.array([(d * x).sum() + 0.1 * (a - 1), d.sum() + 0.01 * b])
        curve = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        move = np.clip(np.linalg.solve(curve, gradient), -1, 1)
        a, b = a - move[0], b - move[1]
    return float(max(a, 0.05)), float(b)


def train(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> Model:
    """Fit on a bounded sample of labelled documents that are not held out."""
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).cast("int").alias("label"))
    )
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id")
    chosen = [
        known.where(F.col("label") == kind).orderBy(order, "doc_id").limit(most)
        for kind, most in ((1, toxic), (0, clean))
    ]
    wanted = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most toxic + clean rows
    sample = materialize(
        docs.select(docs["doc_id"], F.coalesce(docs["text"], F.lit("")).alias("text"))
        .join(wanted, "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.min("text").alias("text")),
        "toxicity-sample",
    )
    sampled = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    clean_weight, toxic_weight = (counts.get(kind, 0) / max(1, sampled.get(kind, 0)) for kind in (0, 1))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        texts = pa.concat_arrays([b.column(0) for b in rows])
        labels = [label for b in rows for label in b.column(1).to_pylist()]
        model = fit(texts, labels, (clean_weight, toxic_weight))
        yield pa.record_batch([pa.array([pickle.dumps(model)], type=pa.binary())], names=["model"])

    ship_package(docs.sparkSession)
    if not sampled:
        return fit([], [])
    in_order = sample.coalesce(1).sortWithinPartitions("doc_id").select("text", "label")
    return pickle.loads(bytes(in_order.mapInArrow(fitted, "model binary").first()["model"]))


def score(df: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """Add the score of every whole text. One scan, no shuffle; the model has a fixed size."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(texts))

    return df.withColumn(to, scored(F.coalesce(df[text], F.lit(""))))


