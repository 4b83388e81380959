"""Secrets in texts: rules, and a character convolutional network over every candidate and its context.

The rules find `assign`, `access` and `hex` spans. Candidates are all runs of at least `SHORTEST` characters of
the alphabet of secrets that hold a letter and a digit; the network reads `BEFORE` characters before a candidate, its first
`INSIDE` and `AFTER` behind the window, each with the place it has (outside or inside). A candidate that overlaps no
rule's span and scores at or above the threshold of its shape is a span of kind `network`. Spans of the rules always stay.

The network learns from labelled findings: every candidate of every different document, in parts of about `PART_ROWS` by a
hash. A candidate with a finding is a secret, any other is none. Findings are
shown also respelled in other alphabets and in the surroundings of candidates that are none, so that the network does not
learn the rules' keywords alone; values of none are shown behind the findings' keywords. In each epoch the parts are learned side by
side from the same parameters, which are then averaged by the rows shown. A fifth of the documents
calibrates: logistic regression turns logits into probabilities. The threshold of each shape must keep `RECALL` of its
findings, as shown (of all findings where a shape has fewer than `FEW`); it lies half-way between the highest that does and
the best candidate below it that is none, at even odds or above. As rules miss secrets, a candidate without a finding that looks like one half-way is not shown as none afterwards.

The driver gets sums of parameters (`SLOTS` at most, some 40 KB each) and counts of held-out rows by logit in steps of 1/`STEPS`.

Defined cases: a null or empty text has no spans; with no finding or no other candidate the rules stand alone;
rows that repeat an id are rows of their own; columns of other names are passed through; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.words import runs
from inkwell.session import materialize
from inkwell.sources.shipping import ship_package

# The rules' patterns and the least length of what they find.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGN_VALUE = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # the first four and 14 more: 18 or more in all
HEX = re.compile(r"[0-9a-f]{16,}")
# Texts that none of these matches have no finding; a superset, for the regular expressions of Arrow.
_MAY_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]"""
_MAY_ACCESS = "AKIA[A-Z0-9]{14}"
_MAY_HEX = "[0-9a-f]{16}"

SHORTEST = 16
BEFORE, INSIDE, AFTER = 24, 40, 8
WIDTH = BEFORE + INSIDE + AFTER
SYMBOLS = 98  # printable ASCII, any other character, nothing
EMBED, FILTERS, REACH = 8, 24, 5
PART_ROWS, SLOTS = 32_768, 16
STEPS, FARTHEST = 256, 40
EPOCHS, BATCH = 6, 64
RECALL, FEW = 0.98, 30
AT_ONCE = 2048
RUN_BYTES = 1 << 20
NETWORK = "network"

_VALUE = np.zeros(256, dtype=bool)
_VALUE[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[list(b"0123456789")] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_SYMBOL = np.full(256, 95, dtype=np.uint8)
_SYMBOL[32:127] = np.arange(95)
_SYMBOL[[9, 10, 13]] = 0
_NOTHING, _OTHER = 96, 95


def rule_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the rules' findings, in order of start, then kind as listed."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_VALUE]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def rule_findings(texts: pa.Array) -> dict[int, list[tuple[int, int, str]]]:
    """Findings of the rules in those texts of a column that have any."""
    may = pc.match_substring_regex(texts, _MAY_ASSIGN)
    for pattern in (_MAY_ACCESS, _MAY_HEX):
        may = pc.or_(may, pc.match_substring_regex(texts, pattern))
    found = {}
    for i in np.flatnonzero(may.to_numpy(zero_copy_only=False)).tolist():
        spans = rule_spans(texts[i].as_py())
        if spans:
            found[i] = spans
    return found


@dataclass
class Candidates:
    """Candidates of a run of texts: text, first and last code point, shape, and what the network reads."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    shape: np.ndarray
    symbols: np.ndarray  # (candidates, WIDTH)


SHAPES = ("hexadecimal", "capitals", "mixed")


def candidates_of(data: np.ndarray, offsets: np.ndarray) -> Candidates:
    """All runs of the alphabet of secrets with a letter and a digit, and their surroundings in the same text."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = _VALUE[data]
    step = inside[1:] != inside[:-1]
    step[offsets] |= inside[1:][offsets] | inside[:-1][offsets]  # a text ends what stands at its end
    cuts = np.flatnonzero(step)
    begin, end = cuts[:-1], cuts[1:]
    long = (end - begin >= SHORTEST) & inside[1:-1][np.minimum(begin, max(0, len(data) - 1))] if len(begin) else np.zeros(0, bool)
    begin, end = begin[long], end[long]

    def some(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[data], dtype=np.int32)])
        return sums[end] - sums[begin]

    letters = some(_LETTER)
    mixed = (letters > 0) & (some(_DIGIT) > 0) if len(begin) else np.zeros(0, bool)
    begin, end, letters = begin[mixed], end[mixed], letters[mixed]
    text = np.searchsorted(offsets, begin, "right") - 1
    if not len(begin):
        none = np.zeros(0, dtype=np.int64)
        return Candidates(none, none, none, none, np.zeros((0, WIDTH), dtype=np.uint8))
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)])  # characters before each byte
    start_char, end_char = lead[begin] - lead[offsets[text]], lead[end] - lead[offsets[text]]
    at = begin[:, None] + np.arange(-BEFORE, INSIDE + AFTER)
    outside = (at < offsets[text][:, None]) | (at >= offsets[text + 1][:, None])
    symbols = _SYMBOL[data[np.clip(at, 0, len(data) - 1)]]
    symbols[outside] = _NOTHING
    small = some(_table(b"abcdef")) + some(_table(b"ABCDEF"))
    capitals = some(_table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    shape = np.where(small == letters, 0, np.where(capitals == letters, 1, 2))
    return Candidates(text, start_char.astype(np.int64), end_char.astype(np.int64), shape, symbols)


def _table(characters: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(characters)] = True
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Character embedding, one convolution, maximum over the places before, in and after the candidate, a logit."""

    def __init__(self, seed: int = 3):
        random = np.random.default_rng(seed)
        self.p = {
            "embed": random.standard_normal((SYMBOLS, EMBED)) * 0.3,
            "filter": random.standard_normal((REACH * EMBED, FILTERS)) * 0.2,
            "bias": np.zeros(FILTERS),
            "out": random.standard_normal(2 * FILTERS) * 0.2,
            "out_b": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _convolved(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vectors = self.p["embed"][symbols]  # (n, WIDTH, EMBED)
        places = WIDTH - REACH + 1
        windows = np.concatenate([vectors[:, j : j + places] for j in range(REACH)], axis=2)
        return windows, windows @ self.p["filter"] + self.p["bias"]

    def forward(self, symbols: np.ndarray, keep: bool = False):
        """Logits; places in front of the candidate and the rest are pooled apart."""
        windows, raw = self._convolved(symbols)
        border = BEFORE - REACH // 2
        best = [raw[:, :border].argmax(axis=1), raw[:, border:].argmax(axis=1) + border]
        rows = np.arange(len(symbols))[:, None]
        columns = np.arange(FILTERS)
        top = np.concatenate([raw[rows, at, columns] for at in best], axis=1)
        pooled = np.maximum(top, 0)
        logits = pooled @ self.p["out"] + self.p["out_b"]
        return (logits, (windows, best, top, pooled)) if keep else logits

    def logits(self, symbols: np.ndarray) -> np.ndarray:
        parts = [self.forward(symbols[lo : lo + AT_ONCE]) for lo in range(0, len(symbols), AT_ONCE)]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.float32)

    def gradients(self, symbols: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        logits, (windows, best, top, pooled) = self.forward(symbols, keep=True)
        d = ((_sigmoid(logits) - labels) * weights / len(labels)).astype(np.float32)
        g = {"out": pooled.T @ d, "out_b": d.sum(keepdims=True)}
        d_top = d[:, None] * self.p["out"] * (top > 0)
        g["bias"] = np.zeros_like(self.p["bias"])
        g["filter"] = np.zeros_like(self.p["filter"])
        g["embed"] = np.zeros_like(self.p["embed"])
        rows = np.arange(len(symbols))[:, None]
        for side, at in enumerate(best):
            d_side = d_top[:, side * FILTERS : (side + 1) * FILTERS]  # (n, FILTERS)
            g["bias"] += d_side.sum(axis=0)
            chosen = windows[rows, at]  # (n, FILTERS, REACH * EMBED)
            g["filter"] += np.einsum("nfe,nf->ef", chosen, d_side)
            d_windows = d_side[:, :, None] * self.p["filter"].T  # (n, FILTERS, REACH * EMBED)
            for j in range(REACH):
                part = d_windows[:, :, j * EMBED : (j + 1) * EMBED]
                np.add.at(g["embed"], symbols[rows, at + j].ravel(), part.reshape(-1, EMBED))
        return g


@dataclass
class Model:
    """A network with its calibration; no network: the rules stand alone."""

    network: Network | None = None
    slope: float = 1.0
    shift: float = 0.0
    thresholds: list[float] = field(default_factory=lambda: [1.0] * len(SHAPES))

    def probabilities(self, symbols: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.network.logits(symbols).astype(float) + self.shift)

    def added(self, found: Candidates) -> np.ndarray:
        """Which candidates are secrets to the network."""
        if self.network is None or not len(found.text):
            return np.zeros(len(found.text), dtype=bool)
        return self.probabilities(found.symbols) >= np.array(self.thresholds)[found.shape]


def labelled(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, labels, shapes and texts of all candidates of a column; those with a finding of a rule are secrets."""
    findings = rule_findings(texts)
    symbols, labels, shapes, owners = [], [], [], []
    for lo, _, data, offsets in runs(texts, RUN_BYTES):
        found = candidates_of(data, offsets)
        symbols.append(found.symbols)
        shapes.append(found.shape)
        owners.append(lo + found.text)
        labels.append(_overlaps(found, lo, findings))
    if not symbols:
        return np.zeros((0, WIDTH), dtype=np.uint8), *[np.zeros(0, dtype=np.int64)] * 3
    return np.concatenate(symbols), np.concatenate(labels).astype(np.int64), np.concatenate(shapes), np.concatenate(owners)


def _overlaps(found: Candidates, lo: int, findings: dict[int, list[tuple[int, int, str]]]) -> np.ndarray:
    """Which candidates share a character with a finding of a rule."""
    out = np.zeros(len(found.text), dtype=bool)
    for i, (text, start, end) in enumerate(zip(found.text.tolist(), found.start.tolist(), found.end.tolist(), strict=True)):
        out[i] = any(a < end and start < b for a, b, _ in findings.get(lo + text, ()))
    return out


_ALNUM = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8) - 32
# letters and digits, base 64, capitals and digits, hexadecimal digits in capitals; with the shape of each
_ALPHABETS = ((_ALNUM[:62], 2), (_ALNUM, 2), (_ALNUM[[*range(26), *range(52, 62)]], 1), (_ALNUM[[*range(52, 62), *range(6)]], 0))


def _respelled(symbols: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Findings with random characters of another alphabet in the place of theirs, and the shapes of the new ones."""
    out, shapes = symbols.copy(), np.zeros(len(symbols), dtype=np.int64)
    value = out[:, BEFORE : BEFORE + INSIDE]
    run = np.logical_and.accumulate((value < 95) & _VALUE[np.minimum(value, 94) + 32], axis=1)
    for i in range(len(out)):
        alphabet, shapes[i] = _ALPHABETS[rng.integers(len(_ALPHABETS))]
        value[i][run[i]] = rng.choice(alphabet, INSIDE)[run[i]]
    return out, shapes


def _swapped(values: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Values of some rows behind the surroundings of others."""
    out = values.copy()
    out[:, :BEFORE] = around[:, :BEFORE]
    return out


def fit(symbols: np.ndarray, labels: np.ndarray, shapes: np.ndarray, owners: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Train on four fifths of the documents, calibrate and set thresholds on the rest; all in memory, as one part."""
    if not len(labels) or labels.min() == labels.max():
        return Model()
    rng = np.random.default_rng(5)
    fold = np.array([hashlib.md5(str(o).encode()).digest()[0] % 5 == 0 for o in owners.tolist()])
    if any(not (fold & (labels == k)).any() or not (~fold & (labels == k)).any() for k in (0, 1)):
        fold = np.zeros(len(labels), dtype=bool)  # too few to hold any back
    x, y, _ = _shown(symbols[~fold], labels[~fold], shapes[~fold], rng)
    learner = Learner()
    for epoch in range(epochs):
        if epoch == epochs // 2:
            # rules miss secrets: what looks like one by now is not shown as none any more
            doubt = _doubted(learner.network, x, y)
            x, y = x[~doubt], y[~doubt]
        learner.learn(x, y, int(y.sum()), int((y == 0).sum()), rng)
    held = fold if fold.any() else np.ones(len(labels), dtype=bool)
    x, y, shape = _shown(symbols[held], labels[held], shapes[held], rng)
    return _calibrated(learner.network, learner.network.logits(x).astype(float), y, shape, np.ones(len(y)))


class Learner:
    """A network and the moments of its gradients (Adam)."""

    def __init__(self) -> None:
        self.network = Network()
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.network.p.items()}
        self.step = 0.0

    def learn(self, x: np.ndarray, y: np.ndarray, secrets: int, others: int, rng: np.random.Generator) -> None:
        """Every row once, in random order; `secrets` and `others`, of all parts, give both the same weight."""
        weight = np.where(y == 1, (secrets + others) / max(1, 2 * secrets), (secrets + others) / max(1, 2 * others))
        order = rng.permutation(len(y))
        for lo in range(0, len(order), BATCH):
            at = order[lo : lo + BATCH]
            self.step += 1
            for k, grad in self.network.gradients(x[at], y[at], weight[at]).items():
                m, v = self.moments[k]
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                self.network.p[k] -= 0.004 * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-7)

    def _arrays(self) -> list[np.ndarray]:
        return [a for k, value in self.network.p.items() for a in (value, *self.moments[k])]

    def state(self) -> np.ndarray:
        return np.concatenate([[self.step], *[a.ravel() for a in self._arrays()]]).astype(np.float64)

    def load(self, state: np.ndarray) -> Learner:
        self.step, place = float(state[0]), 1
        for a in self._arrays():
            a[...] = state[place : place + a.size].reshape(a.shape)
            place += a.size
        return self


def _doubted(network: Network, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows shown as none that look like a secret."""
    return (y == 0) & (network.logits(x) > 0)


def _shown(symbols: np.ndarray, labels: np.ndarray, shapes: np.ndarray, rng: np.random.Generator):
    """Findings as they are, respelled and in other surroundings; others as they are and behind findings' keywords."""
    secret, plain = symbols[labels == 1], symbols[labels == 0]
    own, other = shapes[labels == 1], shapes[labels == 0]
    if not len(secret) or not len(plain):  # a part without one of them
        respelled, shape = _respelled(secret, rng)
        x = np.concatenate([secret, respelled, plain])
        return x, np.repeat([1, 0], [2 * len(secret), len(plain)]), np.concatenate([own, shape, other])
    around = plain[rng.integers(len(plain), size=len(secret))]
    respelled, shape = _respelled(secret, rng)
    behind = _swapped(plain, secret[rng.integers(len(secret), size=len(plain))])
    x = np.concatenate([secret, respelled, _swapped(secret, around), _swapped(respelled, around), plain, behind])
    y = np.repeat([1, 0], [4 * len(secret), 2 * len(plain)])
    return x, y, np.concatenate([own, shape, own, shape, other, other])


def _calibrated(network: Network, logits: np.ndarray, y: np.ndarray, shape: np.ndarray, count: np.ndarray) -> Model:
    """Probabilities by logistic regression, and thresholds that keep `RECALL` of the findings of each shape.

    `count`: how many rows have this logit, label and shape.
    """
    sure = ((y == 1) | (logits <= 0)) * count
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps with a little shrinkage
        p = _sigmoid(a * logits + b)
        d, w = (p - y) * sure, p * (1 - p) * sure
        slope = np.array([(d * logits).sum() + 0.1 * (a - 1), d.sum() + 0.01 * b])
        curve = np.array(
            [[(w * logits * logits).sum() + 0.1, (w * logits).sum()], [(w * logits).sum(), w.sum() + 0.01]]
        )
        move = np.clip(np.linalg.solve(curve, slope), -1, 1)
        a, b = a - move[0], b - move[1]
    model = Model(network, float(max(a, 0.05)), float(b))
    p = _sigmoid(model.slope * logits + model.shift)
    for k in range(len(SHAPES)):
        chosen = (y == 1) & (shape == k)
        if count[chosen].sum() < FEW:
            chosen = y == 1
        order = np.argsort(p[chosen])
        upto = np.cumsum(count[chosen][order])
        most = float(p[chosen][order][np.searchsorted(upto, int((1 - RECALL) * upto[-1]), "right")])
        others = p[(y == 0) & (sure > 0) & (p < most)]
        model.thresholds[k] = max(0.5, (most + float(others.max(initial=0.0))) / 2)
    return model


def candidate_rows(docs: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Every candidate of every different document, written once: part, fold, key and place, symbols, label, shape."""
    text = F.coalesce(docs["text"], F.lit(""))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols, labels, shapes, owners = labelled(batch.column(1))
            place = np.arange(len(owners)) - np.searchsorted(owners, owners)
            ends = pa.py_buffer(np.arange(len(owners) + 1, dtype=np.int32) * WIDTH)
            yield pa.record_batch(
                [
                    batch.column(0).take(pa.array(owners, type=pa.int64())),
                    pa.array(place, type=pa.int32()),
                    pa.Array.from_buffers(pa.binary(), len(owners), [None, ends, pa.py_buffer(symbols.tobytes())]),
                    pa.array(labels, type=pa.int32()),
                    pa.array(shapes, type=pa.int32()),
                ],
                names=["key", "place", "symbols", "label", "shape"],
            )

    rows = docs.select(F.xxhash64(docs["doc_id"], text).alias("key"), text.alias("text")).mapInArrow(
        found, "key bigint, place int, symbols binary, label int, shape int"
    )
    rows = materialize(rows.dropDuplicates(["key", "place"]), "secret-candidates")
    parts = max(1, -(-rows.count() // part_rows))
    return rows.select(
        F.pmod(F.xxhash64("key", "place"), F.lit(parts)).cast("int").alias("part"),
        (F.pmod(F.xxhash64("key", F.lit("fold")), F.lit(5)) == 0).alias("fold"),
        "*",
    )


def _columns(part: pa.Table) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Number, symbols, labels and shapes of a part, always in the same order."""
    part = part.sort_by([("key", "ascending"), ("place", "ascending")])
    symbols = np.frombuffer(b"".join(part.column("symbols").to_pylist()), dtype=np.uint8).reshape(-1, WIDTH)
    labels, shapes = (part.column(c).to_numpy().astype(np.int64) for c in ("label", "shape"))
    return part.column("part")[0].as_py(), symbols, labels, shapes


def train(docs: DataFrame, part_rows: int = PART_ROWS, epochs: int = EPOCHS) -> Model:
    """Fit on every candidate of every different document; parts are learned side by side and averaged."""
    ship_package(docs.sparkSession)
    rows = candidate_rows(docs, part_rows)
    numbers = {(r["fold"], r["label"]): r["count"] for r in rows.groupBy("fold", "label").count().collect()}
    if len({label for _, label in numbers}) < 2:
        return Model()
    hold = len(numbers) == 4  # else too few to hold any back
    parts = rows.agg(F.max("part")).first()[0] + 1

    def of_parts(fold: bool, function, schema: str) -> DataFrame:
        chosen = rows.where(F.col("fold") == fold) if hold else rows
        return chosen.repartition(parts, "part").groupBy("part").applyInArrow(function, schema)

    def shown(part: pa.Table, doubter: np.ndarray | None):
        number, *columns = _columns(part)
        x, y, _ = _shown(*columns, np.random.default_rng([5, number]))
        if doubter is not None:
            doubt = _doubted(Learner().load(doubter).network, x, y)
            x, y = x[~doubt], y[~doubt]
        return number, x, y

    def totals(doubter: np.ndarray | None) -> tuple[int, int]:
        def count(part: pa.Table) -> pa.Table:
            _, _, y = shown(part, doubter)
            return pa.table({"secrets": [int(y.sum())], "others": [int((y == 0).sum())]})

        counted = of_parts(False, count, "secrets bigint, others bigint")
        return tuple(counted.agg(F.sum("secrets"), F.sum("others")).first())

    def learned(epoch: int, state: np.ndarray, doubter: np.ndarray | None, secrets: int, others: int) -> np.ndarray:
        def learn(part: pa.Table) -> pa.Table:
            number, x, y = shown(part, doubter)
            learner = Learner().load(state)
            learner.learn(x, y, secrets, others, np.random.default_rng([7, number, epoch]))
            weighted = (learner.state() * len(y)).tobytes()
            return pa.table({"part": [number], "slot": [number % SLOTS], "rows": [float(len(y))], "state": [weighted]})

        def add(some: pa.Table) -> pa.Table:
            some = some.sort_by("part")
            total = sum(np.frombuffer(one, dtype=np.float64) for one in some.column("state").to_pylist())
            return pa.table({"slot": some.column("slot")[:1], "rows": [sum(some.column("rows").to_pylist())], "state": [total.tobytes()]})

        of_part = of_parts(False, learn, "part bigint, slot bigint, rows double, state binary")
        sums = of_part.groupBy("slot").applyInArrow(add, "slot bigint, rows double, state binary").collect()
        sums.sort(key=lambda r: r["slot"])
        return sum(np.frombuffer(r["state"], dtype=np.float64) for r in sums) / sum(r["rows"] for r in sums)

    state, doubter, (secrets, others) = Learner().state(), None, totals(None)
    for epoch in range(epochs):
        if epoch == epochs // 2:
            # rules miss secrets: what looks like one by now is not shown as none any more
            doubter = state
            secrets, others = totals(doubter)
        state = learned(epoch, state, doubter, secrets, others)
    network = Learner().load(state).network

    def measured(part: pa.Table) -> pa.Table:
        number, *columns = _columns(part)
        x, y, shape = _shown(*columns, np.random.default_rng([9, number]))
        logit = np.rint(np.clip(network.logits(x), -FARTHEST, FARTHEST) * STEPS).astype(np.int64)
        values, count = np.unique(np.stack([y, shape, logit], axis=1), axis=0, return_counts=True)
        return pa.table([*(pa.array(v) for v in values.T), pa.array(count)], names=["label", "shape", "logit", "count"])

    held = of_parts(True, measured, "label bigint, shape bigint, logit bigint, count bigint")
    bins = held.groupBy("label", "shape", "logit").agg(F.sum("count").alias("count")).collect()
    label, shape, logit, count = np.array([tuple(r) for r in sorted(bins)], dtype=np.int64).T
    return _calibrated(network, logit / STEPS, label, shape, count)


_SPANS = pa.struct([
    ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
])


def find_spans(texts: pa.Array, model: Model) -> list[list[tuple[int, int, str]]]:
    """Spans of every text: the rules' and those that the network adds, by start, then kind."""
    findings = rule_findings(texts)
    out = [list(findings.get(i, ())) for i in range(len(texts))]
    for lo, _, data, offsets in runs(texts, RUN_BYTES):
        found = candidates_of(data, offsets)
        add = model.added(found) & ~_overlaps(found, lo, findings)
        for i in np.flatnonzero(add).tolist():
            out[lo + int(found.text[i])].append((int(found.start[i]), int(found.end[i]), NETWORK))
    order = (*KINDS, NETWORK)
    return [sorted(spans, key=lambda s: (s[0], order.index(s[2]))) for spans in out]


def scan(df: DataFrame, model: Model, text: str = "text", to: str = "secrets") -> DataFrame:
    """Add the spans of every whole text: an array of (kind, start, end), code points, end exclusive. One scan, no shuffle."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<struct<kind:string,start:bigint,end:bigint>>")
    def scanned(texts: pa.Array) -> pa.Array:
        spans = find_spans(texts, shared.value)
        rows = [[{"kind": k, "start": a, "end": b} for a, b, k in one] for one in spans]
        return pa.array(rows, type=pa.list_(_SPANS))

    return df.withColumn(to, scanned(F.coalesce(df[text], F.lit(""))))
