"""Words of Arrow text columns as numpy arrays: their places and 64-bit hashes.

No Python object is made for a word. Texts are handled in runs of about `RUN_BYTES`, so
memory follows the longest single text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES = 1 << 20

# White space that ends a word: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# Bytes with A-Z in lower case, plus one, so that no byte is zero in a hash.
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
LOWER_PLUS_ONE = _LOWER + np.uint64(1)

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; a bijection."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(values: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Sums s of values[i] * base ** i; `range_hash` reads hashes of ranges from them."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, back: int = _BACK) -> np.ndarray:
    """Hashes of values[start:end] that do not depend on the place."""
    return mix((sums[end] - sums[start]) * powers(back, len(sums))[start])


@dataclass
class Words:
    """Words of a run of texts. `first[i]:first[i + 1]` are the words of text i."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @property
    def texts(self) -> int:
        return len(self.first) - 1

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts), np.diff(self.first))


def runs(texts: pa.Array, limit: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a text column into runs: (from row, to row, bytes, offsets of the texts in them).

    A null counts as an empty text.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    n = len(texts)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n, lo + 65536)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a run of texts, with hashes (of A-Z in lower case)."""
    inside = ~SPACE[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    before[cuts] = False
    after[cuts[cuts > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    values = LOWER_PLUS_ONE[data] if lower else data.astype(np.uint64) + np.uint64(1)
    hashed = range_hash(prefix_sums(values), start, end)
    first = np.searchsorted(start, offsets, "left")
    return Words(data, start, end, first, hashed)


def shingles(words: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every run of n words; a shorter text is one shingle, an empty one none."""
    length = np.diff(words.first)
    total = len(words)
    factors = powers(0xD6E8FEB86659FD93, n + 1)[1:]
    texts, hashes = [], []
    if total >= n:
        summed = np.zeros(total - n + 1, dtype=np.uint64)
        for j in range(n):
            summed += words.hash[j : total - n + 1 + j] * factors[j]
        text = words.text_of[: total - n + 1]
        whole = np.arange(total - n + 1) + n <= words.first[1:][text]
        texts.append(text[whole])
        hashes.append(mix(summed[whole]))
    short = np.flatnonzero((length > 0) & (length < n))
    if len(short):
        summed = np.zeros(len(short), dtype=np.uint64)
        for j in range(n - 1):
            has = length[short] > j
            summed[has] += words.hash[words.first[short[has]] + j] * factors[j]
        texts.append(short)
        hashes.append(mix(summed + length[short].astype(np.uint64)))
    if not texts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(texts), np.concatenate(hashes)


def word_bytes(words: Words, at: np.ndarray, lower: bool = True) -> list[bytes]:
    """The chosen words themselves."""
    raw = words.data.tobytes()
    found = [raw[s:e] for s, e in zip(words.start[at].tolist(), words.end[at].tolist(), strict=True)]
    return [w.lower() for w in found] if lower else found  # bytes.lower() changes A-Z only


def as_signed(hashes: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's BIGINT."""
    return hashes.view(np.int64)
