"""Byte-level BPE: a backtracking encoder with exact merges, and a decoder over an offset table.

A text is cut into pieces by the byte-level pattern; this is done on arrays of character classes.
A piece is encoded from left to right: an Aho-Corasick automaton gives every token that
starts at a place, the longest is tried first, and it may follow the token before only if the
pair-compatibility table says that the merges would leave both as they are. If no token fits, the last one
is taken back; places found to lead nowhere are marked, so the work is linear in the piece.
This gives what applying the merges in order gives. Every distinct piece is encoded once per
worker; decoding gathers token bytes from one flat table by offsets.

Both ways are checked: the bytes of the ids must be the bytes of the text.

Defined cases: a null text encodes as an empty one; ids outside the vocabulary decode to
nothing; bytes that are not UTF-8 decode to U+FFFD; texts of special tokens become those tokens.
The vocabulary has a fixed size and is broadcast.
"""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inkwell.llm.words import prefix_sums, range_hash, runs
from inkwell.sources.shipping import ship_package

SPACE_CLASS, LETTER, NUMBER, OTHER = 0, 1, 2, 3
# Code points with the White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# The contractions of the byte-level pattern, by their letters.
SHORT_ENDINGS = "stmd"
LONG_ENDINGS = ("re", "ve", "ll")
# Ranges that the tokenizer library's older character tables do not know as letters or numbers.
UNKNOWN_RANGES = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F),
    (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2),
    (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7),
    (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8),
    (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF),
    (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4),
    (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479),
    (0x3D000, 0x3FC3F),
]
CACHE_PIECES = 500_000
KNOWN_PAIRS = 300_000
RUN_BYTES = 1 << 19  # some 80 bytes of arrays per byte of text
_FOREVER = 1 << 60


def _class_table() -> np.ndarray:
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    place = np.array([ord(c) for c in points])
    text = "".join(points)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for found in regex.finditer(pattern, text):
            table[place[found.start() : found.end()]] = kind
    for lo, hi in UNKNOWN_RANGES:
        table[lo : hi + 1] = OTHER
    table[WHITE_SPACE] = SPACE_CLASS
    return table


_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    if not _classes:
        _classes.append(_class_table())
    return _classes[0]


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte place, code point) of each character of UTF-8 bytes."""
    place = np.flatnonzero((data & 0xC0) != 0x80)
    points = data[place].astype(np.int32)
    many = np.flatnonzero(points >= 0x80)
    if len(many):
        padded = np.concatenate([data, np.zeros(3, dtype=np.uint8)]).astype(np.int32)
        at, lead = place[many], points[many]
        b1, b2, b3 = (padded[at + k] & 0x3F for k in (1, 2, 3))
        two = ((lead & 0x1F) << 6) | b1
        three = ((lead & 0x0F) << 12) | (b1 << 6) | b2
        four = ((lead & 0x07) << 18) | (b1 << 12) | (b2 << 6) | b3
        points[many] = np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, np.minimum(four, 0x10FFFF)))
    return place, points


def piece_starts(data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Byte places where pieces of the byte-level pattern start. `cuts`: places no piece crosses."""
    place, points = code_points(data)
    n = len(place)
    kind = classes()[points]
    segment = np.zeros(n + 1, dtype=bool)
    segment[np.searchsorted(place, cuts)] = True
    segment[n] = True
    segment = segment[: n + 1]
    first = segment[:n].copy()
    if n:
        first[0] = True
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE_CLASS
    ends_here = segment[1:]
    next_word = np.zeros(n, dtype=bool)
    next_word[:-1] = ~space[1:]
    next_word &= ~ends_here
    after_blank = np.zeros(n, dtype=bool)
    after_blank[1:] = points[:-1] == 0x20
    after_blank &= ~first
    starts = (space & (run | next_word)) | (~space & run & ~after_blank)
    quote = np.flatnonzero((points == 0x27) & starts)
    if len(quote):
        quote = quote[~ends_here[quote]]
        padded = np.concatenate([points, [0, 0, 0]])
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, [ord(c) for c in SHORT_ENDINGS])
        long = np.zeros(len(quote), dtype=bool)
        inside = ~segment[np.minimum(quote + 2, n)]
        for ending in LONG_ENDINGS:
            long |= (one == ord(ending[0])) & (two == ord(ending[1])) & inside
        for at in ((quote[short], 2), (quote[long], 3)):
            starts[at[0] + 1] = False
            beyond = at[0] + at[1]
            starts[beyond[beyond < n]] = True
    return place[starts]


class Tokenizer:
    """Tables of one byte-level BPE vocabulary, and the two directions over them."""

    def __init__(self, content: str):
        spec = json.loads(content)
        alphabet = byte_alphabet()
        model = spec["model"]
        as_bytes = lambda text: bytes(alphabet[c] for c in text)
        vocabulary = {as_bytes(t): i for t, i in model["vocab"].items() if all(c in alphabet for c in t)}
        self.special = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        for text in self.special:
            if model["vocab"].get(text.decode()) is not None:
                vocabulary.pop(text, None)
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = (as_bytes(t) for t in (merge if isinstance(merge, list) else merge.split(" ")))
            whole = vocabulary[left + right]
            self.rank.setdefault((vocabulary[left], vocabulary[right]), rank)
            self.halves.setdefault(whole, (vocabulary[left], vocabulary[right], rank))
        self.vocabulary = vocabulary
        self.automaton = ahocorasick.Automaton()
        for token, number in vocabulary.items():
            if len(token) == 1 or number in self.halves:  # others no merge can make
                self.automaton.add_word(token.decode("latin-1"), (len(token), number))
        self.automaton.make_automaton()
        size = max([*vocabulary.values(), *self.special.values()]) + 1
        by_number = [b""] * size
        for token, number in [*vocabulary.items(), *self.special.items()]:
            by_number[number] = token
        self.token_length = np.array([len(t) for t in by_number], dtype=np.int64)
        self.token_offset = np.cumsum(self.token_length) - self.token_length
        self.token_bytes = np.frombuffer(b"".join(by_number), dtype=np.uint8)
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._compatible: dict[tuple[int, int], bool] = {}
        self._forget()

    def _forget(self) -> None:
        """An empty cache: an open-addressed table from piece hashes to slots of a pool of ids."""
        self._keys = np.zeros(1 << 17, dtype=np.uint64)
        self._slots = np.full(1 << 17, -1, dtype=np.int32)
        self._pool = np.zeros(1 << 16, dtype=np.int32)
        self._used = 0
        self._offset = np.zeros(0, dtype=np.int64)
        self._length = np.zeros(0, dtype=np.int64)

    def _find(self, hashed: np.ndarray) -> np.ndarray:
        """Slots of piece hashes, -1 where unknown."""
        mask = np.uint64(len(self._keys) - 1)
        out = np.full(len(hashed), -1, dtype=np.int32)
        todo = np.arange(len(hashed))
        place = (hashed & mask).astype(np.int64)
        while len(todo):
            slot = self._slots[place]
            hit = self._keys[place] == hashed[todo]
            out[todo[hit]] = slot[hit]
            on = ~hit & (slot >= 0)
            todo, place = todo[on], (place[on] + 1) & int(mask)
        return out

    def _put(self, hashed: np.ndarray, slots: np.ndarray) -> None:
        """Enter distinct new hashes; of those that meet in a place, one enters and the others go on."""
        mask = len(self._keys) - 1
        place = (hashed & np.uint64(mask)).astype(np.int64)
        todo = np.arange(len(hashed))
        while len(todo):
            free = self._slots[place] < 0
            self._slots[place[free]] = slots[todo[free]]
            won = free & (self._slots[place] == slots[todo])
            self._keys[place[won]] = hashed[todo[won]]
            todo, place = todo[~won], (place[~won] + 1) & mask

    def _learn(self, hashed: np.ndarray, pieces: list[bytes]) -> None:
        """Encode distinct pieces that are not in the cache and enter them."""
        special, encode = self.special, self.encode_piece
        ids = [[special[p]] if p in special else encode(p) for p in pieces]
        first = len(self._length)
        length = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.array([i for piece in ids for i in piece], dtype=np.int32)
        while self._used + len(flat) > len(self._pool):
            self._pool = np.concatenate([self._pool, np.zeros_like(self._pool)])
        self._pool[self._used : self._used + len(flat)] = flat
        self._offset = np.concatenate([self._offset, self._used + np.cumsum(length) - length])
        self._length = np.concatenate([self._length, length])
        self._used += len(flat)
        if 2 * len(self._length) > len(self._keys):
            keys, slots = self._keys[self._slots >= 0], self._slots[self._slots >= 0]
            size = 1 << int(4 * len(self._length) - 1).bit_length()
            self._keys, self._slots = np.zeros(size, dtype=np.uint64), np.full(size, -1, dtype=np.int32)
            self._put(keys, slots)
        self._put(hashed, np.arange(first, first + len(hashed), dtype=np.int32))

    def _edge(self, token: int, right: bool) -> list[tuple[int, int]]:
        """Tokens that stand at one edge while `token` is built, each with the rank that ends it."""
        memo = self._right if right else self._left
        if token not in memo:
            if token in self.halves:
                *halves, rank = self.halves[token]
                inner = self._edge(halves[1] if right else halves[0], right)
                memo[token] = [*inner[:-1], (inner[-1][0], rank), (token, _FOREVER)]
            else:
                memo[token] = [(token, _FOREVER)]
        return memo[token]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges over the bytes of a and b leave exactly a, b.

        Both are built at the same time, lowest rank first. They fail if at some moment the
        tokens on either side of the border would merge before they grow inward. Of equal
        ranks the left place goes first.
        """
        known = self._compatible.get((a, b))
        if known is None:
            if len(self._compatible) >= KNOWN_PAIRS:
                self._compatible.clear()
            left, right = self._edge(a, True), self._edge(b, False)
            i = j = 0
            known = True
            while True:
                (x, x_ends), (y, y_ends) = left[i], right[j]
                rank = self.rank.get((x, y))
                if rank is not None and rank < x_ends and rank <= y_ends:
                    known = False
                    break
                if x_ends == y_ends == _FOREVER:
                    break
                if x_ends <= y_ends:
                    i += 1
                else:
                    j += 1
            self._compatible[(a, b)] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Token ids of one piece."""
        n = len(piece)
        if n == 1:
            return [self.vocabulary[piece]]
        at: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for end, found in self.automaton.iter(piece.decode("latin-1")):
            at[end - found[0] + 1].append(found)  # shorter ones come first
        table = self._compatible
        dead = bytearray(n + 1)
        path: list[tuple[int, int, int]] = []  # token, where it starts, how many there are left to try
        place, left, last = 0, len(at[0]), -1
        while place < n:
            here = at[place]
            while left:
                left -= 1
                length, token = here[left]
                if not dead[place + length]:
                    if last < 0:
                        break
                    fits = table.get((last, token))
                    if fits or (fits is None and self.compatible(last, token)):
                        break
            else:
                dead[place] = 1
                _, place, left = path.pop()
                last = path[-1][0] if path else -1
                continue
            path.append((token, place, left))
            last = token
            place += length
            left = len(at[place])
        return [token for token, _, _ in path]

    def encode_run(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of the texts in them) of a run of texts."""
        if not len(data):
            return np.zeros(0, dtype=np.int32), np.zeros(len(offsets), dtype=np.int64)
        raw = data.tobytes()
        cuts = [offsets[:-1][offsets[:-1] < len(data)]]
        for text in self.special:
            found = raw.find(text)
            while found >= 0:
                # a special token that crosses two texts is none
                if np.searchsorted(offsets, found, "right") == np.searchsorted(offsets, found + len(text) - 1, "right"):
                    cuts.append(np.array([found, found + len(text)]))
                    found = raw.find(text, found + len(text))
                else:
                    found = raw.find(text, found + 1)
        bounds = np.unique(np.concatenate(cuts))
        special_at = np.concatenate(cuts[1:]).reshape(-1, 2) if len(cuts) > 1 else np.zeros((0, 2), dtype=np.int64)
        start = piece_starts(data, bounds[bounds < len(data)])
        for lo, hi in special_at.tolist():
            start = start[(start <= lo) | (start >= hi)]
        end = np.append(start[1:], len(data))
        if len(self._length) > CACHE_PIECES:
            self._forget()
        hashed = range_hash(prefix_sums(data.astype(np.uint64) + np.uint64(1)), start, end)
        slot = self._find(hashed)
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            new, one = np.unique(hashed[missing], return_index=True)
            at = missing[one]
            self._learn(new, [raw[s:e] for s, e in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            slot[missing] = self._find(hashed[missing])
        ids, counts = _gather(self._pool, self._offset[slot], self._length[slot]), self._length[slot]
        if not np.array_equal(self.bytes_of(ids), data):  # two pieces of one hash: without the cache
            each = [
                [self.special[p]] if p in self.special else self.encode_piece(p)
                for p in (raw[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True))
            ]
            ids = np.array([i for piece in each for i in piece], dtype=np.int32)
            counts = np.array([len(piece) for piece in each], dtype=np.int64)
            if not np.array_equal(self.bytes_of(ids), data):
                raise ValueError("ids do not give back the text")
        total = np.concatenate([[0], np.cumsum(counts)])
        return ids, total[np.searchsorted(start, offsets, "left")]

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return _gather(self.token_bytes, self.token_offset[ids], self.token_length[ids])

    def decode_run(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets of the texts in them) of a run of id lists."""
        known = (ids >= 0) & (ids < len(self.token_length))
        ids = np.where(known, ids, 0)
        length = np.where(known, self.token_length[ids], 0)
        data = _gather(self.token_bytes, self.token_offset[ids], length)
        return data, np.concatenate([[0], np.cumsum(length)])[offsets]


def _gather(values: np.ndarray, offset: np.ndarray, length: np.ndarray) -> np.ndarray:
    """values[offset : offset + length] of every row, one after the other."""
    before = np.cumsum(length) - length
    return values[np.repeat(offset - before, length) + np.arange(int(length.sum()))]


_tokenizers: OrderedDict[str, Tokenizer] = OrderedDict()


def tokenizer_of(content: str) -> Tokenizer:
    if content not in _tokenizers:
        while len(_tokenizers) >= 2:
            _tokenizers.popitem(last=False)
        _tokenizers[content] = Tokenizer(content)
    return _tokenizers[content]


class _Lists:
    """Collects runs of ids into one Arrow list column."""

    def __init__(self):
        self.values, self.offsets, self.total = [], [np.zeros(1, dtype=np.int64)], 0

    def add(self, ids: np.ndarray, places: np.ndarray) -> None:
        self.values.append(ids.astype(np.int32, copy=False))
        self.offsets.append(places[1:] + self.total)
        self.total += len(ids)

    def array(self) -> pa.ListArray:
        values = np.concatenate(self.values) if self.values else np.zeros(0, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(np.concatenate(self.offsets).astype(np.int32)), pa.array(values))


def _texts(data: np.ndarray, places: np.ndarray) -> pa.Array:
    """The texts of a run of decoded bytes."""
    raw = data.tobytes()
    try:
        raw.decode()  # one check for all, if no text is broken
    except UnicodeDecodeError:
        pass
    else:
        if not len(data) or not ((data[places[:-1][places[:-1] < len(data)]] & 0xC0) == 0x80).any():
            offsets = pa.py_buffer(places.astype(np.int32).tobytes())
            return pa.StringArray.from_buffers(len(places) - 1, offsets, pa.py_buffer(raw))
    bounds = zip(places[:-1].tolist(), places[1:].tolist(), strict=True)
    return pa.array([raw[s:e].decode("utf-8", "replace") for s, e in bounds], type=pa.string())


def _encoder(vocabulary):
    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        tokenizer, out = tokenizer_of(vocabulary.value), _Lists()
        for _, _, data, offsets in runs(texts, RUN_BYTES):
            out.add(*tokenizer.encode_run(data, offsets))
        return out.array()

    return encode


def _decoder(vocabulary, most: int = RUN_BYTES // 4):
    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        tokenizer = tokenizer_of(vocabulary.value)
        values = ids.flatten().to_numpy(zero_copy_only=False)
        counts = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(counts)])
        parts, lo = [], 0
        while lo < len(ids):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
            hi = min(hi, len(ids))
            parts.append(
                _texts(*tokenizer.decode_run(values[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
            )
            lo = hi
        return pa.concat_arrays(parts) if parts else pa.array([], type=pa.string())

    return decode


def _both_ways(vocabulary, text: int, to: str):
    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(vocabulary.value)
        for batch in batches:
            # a batch leaves run by run, so what is held follows the run and not the batch
            for lo, hi, data, offsets in runs(batch.column(text), RUN_BYTES):
                out = _Lists()
                out.add(*tokenizer.encode_run(data, offsets))
                ids = out.array()
                back = _texts(*tokenizer.decode_run(ids.values.to_numpy(), offsets=ids.offsets.to_numpy()))
                tokens = pa.StructArray.from_arrays([ids, back], ["ids", "decoded"])
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, tokens], names=[*part.schema.names, to])

    return both


def _vocabulary(spark: SparkSession, path: str):
    ship_package(spark)
    with open(path, encoding="utf-8") as source:
        return spark.sparkContext.broadcast(source.read())


def encode(df: DataFrame, path: str, text: str = "text", to: str = "ids") -> DataFrame:
    """Add the token ids of `text`. `path` is the vocabulary file, read on the driver."""
    return df.withColumn(to, _encoder(_vocabulary(df.sparkSession, path))(F.coalesce(df[text], F.lit(""))))


def decode(df: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Add the text of token ids."""
    empty = F.array().cast("array<int>")
    return df.withColumn(to, _decoder(_vocabulary(df.sparkSession, path))(F.coalesce(df[ids], empty)))


def round_trip(df: DataFrame, path: str, text: str = "text", to: str = "tokens") -> DataFrame:
    """Add a struct of the ids of `text` and the text decoded from them; one pass through Python."""
    rows = df.drop(to)
    kind = StructType.fromDDL(f"{to} struct<ids: array<int>, decoded: string>")
    both = _both_ways(_vocabulary(df.sparkSession, path), rows.columns.index(text), to)
    return rows.mapInArrow(both, StructType([*rows.schema.fields, *kind.fields]))


def ids_digest(ids: Column) -> Column:
    """SHA-256 of decimal ids joined by commas, in lower-case hex."""
    return F.sha2(F.concat_ws(",", ids.cast("array<string>")), 256)
