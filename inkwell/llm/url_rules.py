"""URL rules: a bit-parallel automaton runs all wildcard rules over each canonical URL.

Rules are globs over the canonical form `.host/path`. `*` stands for any run of characters but
`/`, `**` for any run, `?` for one character; other characters stand for themselves. All
patterns lie side by side in the bits of a few machine words (Shift-And): one step per
character moves every pattern at once, and bits of states before a wildcard hold themselves.

Columns added: `host`, `path`, `rule` (text of the longest rule that fits, else null) and
`verdict` (that rule's, else the default).

Defined cases: a null URL or one without `://` has empty host and path and gets the default; of
equal rule texts the first stands; no rules give the default everywhere; other columns pass
through, and a column of the frame named like an added one is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.words import runs
from inkwell.sources.shipping import ship_package

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """A verdict on a host, its subdomains and every path that starts with `path`."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*.{self.host}{self.path}**"


def url_host(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0), UPPER, UPPER.lower())


def url_path(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


class GlobAutomaton:
    """Shift-And over 64-bit words for many globs.

    Bit i of pattern p is set when the pattern's first i elements fit what was read so far.
    The automaton reads UTF-8 bytes; `?` takes a lead byte and holds over its continuations.
    """

    def __init__(self, globs: Sequence[str]):
        consume: list[np.ndarray] = []  # per bit: bytes that move into it
        hold: list[np.ndarray] = []  # per bit: bytes that keep it
        initial: list[int] = []
        self.accept: list[int] = []
        none, every = np.zeros(256, dtype=bool), np.ones(256, dtype=bool)
        no_slash = every.copy()
        no_slash[ord("/")] = False
        follow = none.copy()
        follow[0x80:0xC0] = True
        for glob in globs:
            consume.append(none)  # the state before the first element
            hold.append(none.copy())
            initial.append(len(consume) - 1)
            i = 0
            while i < len(glob):
                if glob.startswith("**", i):
                    hold[-1] |= every
                    i += 2
                elif glob[i] == "*":
                    hold[-1] |= no_slash
                    i += 1
                elif glob[i] == "?":
                    consume.append(~follow)
                    hold.append(follow.copy())
                    i += 1
                else:
                    for byte in glob[i].encode():
                        one = none.copy()
                        one[byte] = True
                        consume.append(one)
                        hold.append(none.copy())
                    i += 1
            self.accept.append(len(consume) - 1)
        self.words = max(1, -(-len(consume) // 64))
        self.move = self._pack(consume)
        self.keep = self._pack(hold)
        self.start = np.zeros(self.words, dtype=np.uint64)
        for bit in initial:
            self.start[bit // 64] |= np.uint64(1) << np.uint64(bit % 64)

    def _pack(self, rows: list[np.ndarray]) -> np.ndarray:
        """(256, words) masks: the bits a byte lets through."""
        bits = np.zeros((256, self.words * 64), dtype=np.uint8)
        if rows:
            bits[:, : len(rows)] = np.array(rows).T
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)

    def fits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, patterns) booleans for a run of texts."""
        length = np.diff(offsets)
        order = np.argsort(-length, kind="stable")
        begin, longest = offsets[:-1][order], length[order]
        state = np.repeat(self.start[None, :], len(order), axis=0)
        active = np.searchsorted(-longest, -np.arange(int(longest.max(initial=0))), "left")
        for step, n in enumerate(active.tolist()):  # the first n texts have a byte here
            byte = data[begin[:n] + step]
            now = state[:n]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:n] = (moved & self.move[byte]) | (now & self.keep[byte])
        out = np.zeros((len(order), len(self.accept)), dtype=bool)
        for p, bit in enumerate(self.accept):
            out[order, p] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) > 0
        return out


def judge_urls(df: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """Add `host`, `path`, `rule` and `verdict` to every row. One scan, no shuffle."""
    ship_package(df.sparkSession)
    ordered = sorted(dict.fromkeys(rules), key=lambda r: -len(r.text))  # stable: first of equals
    automaton = GlobAutomaton([r.glob for r in ordered])

    @F.arrow_udf("int")
    def longest_rule(canonical: pa.Array) -> pa.Array:
        out = np.full(len(canonical), -1, dtype=np.int32)
        for lo, hi, data, offsets in runs(canonical):
            fits = automaton.fits(data, offsets)
            if fits.shape[1]:
                out[lo:hi] = np.where(fits.any(axis=1), fits.argmax(axis=1), -1)
        return pa.array(out)

    named = df.withColumns({"host": url_host(df[url]), "path": url_path(df[url])})
    index = longest_rule(F.concat(F.lit("."), "host", "path"))
    judged = named.withColumn("__rule", index)
    texts = F.array(*[F.lit(r.text) for r in ordered], F.lit(None).cast("string"))
    verdicts = F.array(*[F.lit(r.verdict) for r in ordered], F.lit(default))
    place = F.when(F.col("__rule") < 0, F.lit(len(ordered))).otherwise(F.col("__rule"))
    return judged.withColumns({"rule": texts[place], "verdict": verdicts[place]}).drop("__rule")
