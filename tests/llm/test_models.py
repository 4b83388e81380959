"""Toxicity and language model: exact parts against plain versions, learned parts on held-out rows."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from inkwell.llm import language_model, toxicity

SYLLABLES = ["th", "en", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "ou", "ea", "ti", "or"]
BAD = ["idiot", "moron", "loserify", "scummy"]


def texts_and_labels(n):
    rng = random.Random(3)
    out = []
    for i in range(n):
        text = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 120))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(BAD) + rng.choice(["", ",", "er"]))
        out.append((i, " ".join(text), int(toxic)))
    return out


def test_toxicity_held_out(spark):
    rows = texts_and_labels(900)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(2000, None, "x"), (2001, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, 0), (5, None), (None, 1)], "doc_id long, toxic int")
    scored = toxicity.score(docs.drop("score"), toxicity.train(docs, labels))
    got = {r["doc_id"]: r["score"] for r in scored.collect()}
    held = [(y, got[i]) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum(y == (s >= toxicity.THRESHOLD) for y, s in held) / len(held)
    assert right > 0.95 and got[2000] == got[2001] == 0.0 and all(0 <= s <= 1 for s in got.values())


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, labels)).count() == 2
    assert toxicity.score(docs.limit(0), toxicity.train(docs, labels)).count() == 0


def test_gradients_equal_differences():
    import pyarrow as pa

    from inkwell.llm.words import runs, words_of

    (_, _, data, offsets), = runs(pa.array(["one two three idiot five", "six seven one"]))
    vocabulary = np.unique(words_of(data, offsets).hash)[:4]
    batch = toxicity.batch_of(data, offsets, vocabulary)
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    labels = np.array([1, 0])

    def loss():
        p = 1 / (1 + np.exp(-net.forward(batch, batch.windows).astype(np.float64)))
        return -(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean()

    grads = net.gradients(batch, batch.windows, labels, np.ones(2))
    rng = np.random.default_rng(0)
    for name, value in net.p.items():
        used = np.flatnonzero(np.abs(grads[name].ravel()) > 1e-7)
        for at in rng.choice(used, min(3, len(used)), replace=False):
            flat = value.reshape(-1)
            old = flat[at]
            flat[at] = old + 1e-3
            high = loss()
            flat[at] = old - 1e-3
            lower = loss()
            flat[at] = old
            assert (high - lower) / 2e-3 == pytest.approx(grads[name].ravel()[at], rel=0.05, abs=2e-5), name


def test_language_model(spark):
    rng = random.Random(6)
    pairs = {w: [rng.choice(SYLLABLES) + rng.choice(SYLLABLES) for _ in range(3)] for w in SYLLABLES}
    rows = []
    for i in range(500):
        w = rng.choice(SYLLABLES)
        text = []
        for _ in range(rng.randint(0, 200)):
            text += [w, rng.choice(pairs[w])]
            w = SYLLABLES[(SYLLABLES.index(w) + 1) % len(SYLLABLES)]
        rows.append((i, " ".join(text)))
    rows += [(600, None), (601, "Never Seen words"), (3, rows[3][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, chunk int")
    got = language_model.score_documents(df).collect()
    assert len(got) == len(rows)
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + [0] for _, t in rows]
    counts = collections.Counter()
    for (i, _), x in zip(rows, tokens, strict=True):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(x)
    n, v = sum(counts.values()), len(counts)
    by_id = {r["doc_id"]: r for r in got}
    for (i, _), x in zip(rows, tokens, strict=True):
        r = by_id[i]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in x)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(x), sum(counts[w] > 0 for w in x), n)
        assert r["base_score"] == pytest.approx(base)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert language_model.score_documents(df.limit(0)).count() == 0
    only_held = language_model.score_documents(df.where("crc32(cast(doc_id as string)) % 7 = 2")).collect()
    assert all(r["score"] == r["base_score"] == 0 for r in only_held)


def test_probabilities_add_up():
    shares = np.random.default_rng(1).dirichlet(np.ones(40))
    model = language_model.LogBilinear(shares)
    scores = (model.one[3] + model.two[7]) @ model.target.T + model.bias
    assert np.exp(scores - model.normaliser()[3, 7]).sum() == pytest.approx(1, rel=1e-4)


def test_every_training_token_is_a_target():
    rng = np.random.default_rng(2)
    n_words = np.array([5000, 0, 3000, 700], dtype=np.int32)
    words = np.arange(1, 101, dtype=np.uint64)
    tokens = rng.integers(0, 100, n_words.sum()).astype(np.int32)
    held = [False, False, True, False]
    zeros = np.zeros(language_model.BUCKETS, dtype=np.int64)
    stats = language_model.Statistics(1, 1, 3, words, np.ones(100, dtype=np.int64), zeros, zeros)
    targets = []

    class Recorder:
        def learn(self, target, one, two, random):
            assert len(target) == len(one) == len(two) <= language_model.BATCH
            targets.extend(target.tolist())

    raw = tuple(x.tobytes() for x in (n_words, words, np.zeros(100, dtype=np.int16), tokens))
    seen = language_model.learn_chunk(Recorder(), 7, held, raw, stats)
    learned = np.concatenate([tokens[:5000], tokens[8000:]])
    assert collections.Counter(targets) == collections.Counter([*learned.tolist(), 100, 100, 100])
    assert seen == len(targets) == 5703


def plain_toxicity(model, text):
    """The score of one text, word by word and window by window, in float64."""
    import pyarrow as pa

    from inkwell.llm.words import runs

    p = {k: v.astype(np.float64) for k, v in model.network.p.items()}
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not words:
        return 0.0

    def vector(word):
        (_, _, data, offsets), = runs(pa.array([word]))
        one = toxicity.batch_of(data, offsets, model.vocabulary)
        grams = p["gram"][one.gram].sum(axis=0) / max(1, len(one.gram))
        return np.concatenate([p["word"][one.word[0]], grams])

    def sigmoid(x):
        return 1 / (1 + np.exp(-x))

    def read(vectors, way):
        state, out, n = np.zeros(toxicity.HIDDEN), [], toxicity.HIDDEN
        for x in vectors if way == "f" else vectors[::-1]:
            a, b = x @ p[f"x_{way}"] + p[f"bias_{way}"], state @ p[f"h_{way}"]
            z, r = sigmoid(a[:n] + b[:n]), sigmoid(a[n : 2 * n] + b[n : 2 * n])
            new = np.tanh(a[2 * n :] + r * b[2 * n :])
            state = (1 - z) * new + z * state
            out.append(state)
        return out if way == "f" else out[::-1]

    best = -np.inf
    vectors, start = [vector(w) for w in words], 0
    while True:
        window = vectors[start : start + toxicity.WINDOW]
        h = [np.concatenate(pair) for pair in zip(read(window, "f"), read(window, "b"), strict=True)]
        scores = np.array([np.tanh(x @ p["attend"]) @ p["attend_v"] for x in h])
        weight = np.exp(scores - scores.max())
        pooled = sum(w * x for w, x in zip(weight / weight.sum(), h, strict=True))
        best = max(best, pooled @ p["out"] + p["out_b"][0])
        if start + toxicity.WINDOW >= len(words):
            break
        start += toxicity.STRIDE
    return sigmoid(model.slope * best + model.shift)


@pytest.fixture(scope="module")
def fitted():
    rows = texts_and_labels(1200)
    train = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    held = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    return toxicity.fit([t for t, _ in train], [y for _, y in train]), train, held


def test_scores_equal_a_plain_forward_pass(fitted):
    import pyarrow as pa

    model, _, held = fitted
    long = " ".join(t for t, _ in held[:60])  # thousands of words, many windows
    texts = [t for t, _ in held[:12]] + [None, "", " \n", "one", "ÜBER Straße idiot " * 11, "w " * 32, "w " * 33, "w " * 48 + "moron", long, long]
    got = model.scores(pa.array(texts))
    want = np.array([plain_toxicity(model, t) for t in texts])
    assert np.abs(got - want).max() < 1e-4 and got[-1] == got[-2]


def auc(pairs):
    pairs = list(pairs)
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))


def test_training_beats_the_untrained_network_and_word_counts(fitted):
    """Counts: the largest surplus of a word in toxic texts. The network starts from those, and has to be no worse."""
    import pyarrow as pa

    model, train, held = fitted
    texts, labels = pa.array([t for t, _ in held]), [y for _, y in held]
    trained = auc(zip(model.scores(texts), labels, strict=True))
    raw = toxicity.Model(toxicity.Network(), model.vocabulary, 1.0, 0.0)
    untrained = auc(zip(raw.scores(texts), labels, strict=True))
    seen, toxic = collections.Counter(), collections.Counter()
    for text, y in train:
        seen.update(set(text.split()))
        toxic.update(set(text.split()) if y else ())
    share = sum(y for _, y in train) / len(train)
    surplus = {w: (toxic[w] - share * n) / (share * n + 1) ** 0.5 for w, n in seen.items()}
    counted = auc([(max(surplus.get(w, 0) for w in t.split()), y) for t, y in held])
    assert trained > untrained + 0.2 and trained >= counted - 0.01 and trained > 0.97


def test_repeated_ids_in_the_sample_and_ties(spark):
    rows = texts_and_labels(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] * 2 + [(3, "another text"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] * 3, "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    by_text = collections.defaultdict(set)
    for row in scored:
        by_text[row["text"]].add(row["score"])
    assert len(scored) == 402 and all(max(s) - min(s) < 1e-5 for s in by_text.values())  # float32, in other batches
