"""Merkle manifest of a table: a leaf per row, a tree per source, one root, and a proof for every row.

Leaves of a source stand in the order of their id; every three consecutive nodes (the last run may be
shorter) become the SHA-256 of their digests until one is left. The subroots, in the order of
their sources, become the root in the same way.

A tree is cut into superblocks of `FAN ** LEVELS` leaves, which are whole subtrees. Superblocks are reduced
first; only their tops, one row for each, take part in the levels above, which are reduced and read downwards
again in the same way. Then the leaves and the outer nodes that their superblock needs (its path of
siblings, subroot and root) are cogrouped by superblock, where the local levels, the proofs and
the folding are finished together. Superblocks of small sources share a group. No group holds more
than two spans of narrow rows, whatever the size of a source.

Defined cases: a null id stands first in its source and is never tampered with; rows that repeat an id stand in
the order of their leaves; the null source stands first; a lone row is leaf, subroot and root, and its proof is
the digest of nothing; an empty table gives no rows. Only the five columns of the leaf are read.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.operators.ordering import chunk_offsets, ordered_chunks, with_position
from inkwell.session import materialize
from inkwell.sources.shipping import ship_package

FAN, LEVELS = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NODE = "tree bigint, pos bigint, n bigint, digest string"
_PLACED = _NODE + ", path string"


def digest_of(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def levels_of(nodes: list[str], whole: bool, height: int = LEVELS) -> list[list[str]]:
    """Levels from `nodes` upwards: to a single node, or as many as a superblock of a larger tree has."""
    levels = [nodes]
    while len(levels[-1]) > 1 if whole else len(levels) <= height:
        below = levels[-1]
        levels.append([digest_of(*below[i : i + FAN]) for i in range(0, len(below), FAN)])
    return levels


def siblings_of(levels: list[list[str]]) -> list[list[tuple[str, str]]]:
    """Of every node below the top, the digests to its left and right in its run."""
    return [
        [
            ("".join(nodes[i - i % FAN : i]), "".join(nodes[i + 1 : i - i % FAN + FAN]))
            for i in range(len(nodes))
        ]
        for nodes in levels[:-1]
    ]


def path_of(siblings: list[list[tuple[str, str]]], at: int) -> list[tuple[str, str]]:
    path = []
    for level in siblings:
        path.append(level[at])
        at //= FAN
    return path


def fold(digest: str, path: list[tuple[str, str]]) -> str:
    """What a digest becomes with the siblings of a path."""
    for left, right in path:
        digest = digest_of(left, digest, right)
    return digest


def write_path(path: list[tuple[str, str]]) -> str:
    return ";".join(f"{left}|{right}" for left, right in path)


def read_path(text: str) -> list[tuple[str, str]]:
    return [tuple(level.split("|")) for level in text.split(";")] if text else []


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(df: DataFrame, text: Column | None = None) -> Column:
    """Digest of a row; `text` in place of its text."""
    values = [df[c] for c in FIELDS[:-1]] + [df["text"] if text is None else text]
    return F.sha2(F.concat(*[_field(v) for v in values]), 256)


def without_line_breaks(df: DataFrame) -> Column:
    """Leaf of the row with the line breaks of its text deleted, for every id whose CRC-32 is even; else null."""
    even = F.crc32(df["doc_id"].cast("string").cast("binary")) % 2 == 0
    return F.when(even & df["text"].contains("\n"), leaf_of(df, F.replace(df["text"], F.lit("\n"), F.lit(""))))


def _reduce(pdf: pd.DataFrame, height: int) -> pd.DataFrame:
    """Tops of the subtrees of a group; a subtree is one block of a tree."""
    rows, span = [], FAN**height
    for (tree, block), part in pdf.groupby(["tree", pdf["pos"] // span]):
        n = int(part["n"].iloc[0])
        top = levels_of(part.sort_values("pos")["digest"].tolist(), n <= span, height)[-1][0]
        rows.append((tree, block, -(-n // span), top))
    return pd.DataFrame(rows, columns=["tree", "pos", "n", "digest"])


def _reduce_up(blocks: DataFrame, height: int) -> list[DataFrame]:
    """Tops of superblocks, tops of superblocks of those, and so on until every tree has one node."""
    tiers = [blocks]
    while True:
        many = tiers[-1].where("n > 1")
        if many.isEmpty():
            return tiers
        block = F.expr(f"pos div {FAN**height}")
        above = many.groupBy("tree", block).applyInPandas(lambda pdf: _reduce(pdf, height), _NODE)
        tiers.append(materialize(above, "merkle-tier"))


def _place(nodes: pd.DataFrame, above: pd.DataFrame, height: int) -> pd.DataFrame:
    """Nodes of one subtree with their paths up to the root; `above` is the path of its top."""
    if nodes.empty:
        return _nothing(_PLACED)
    nodes = nodes.sort_values("pos")
    whole = int(nodes["n"].iloc[0]) <= FAN**height
    siblings = siblings_of(levels_of(nodes["digest"].tolist(), whole, height))
    outer = read_path(above["path"].iloc[0])
    paths = [write_path(path_of(siblings, i) + outer) for i in range(len(nodes))]
    return nodes[["tree", "pos", "n", "digest"]].assign(path=paths)


def _path_down(tiers: list[DataFrame], tops: DataFrame, height: int) -> DataFrame:
    """The nodes of the lowest tier with their paths; `tops` has the path of every tree."""
    placed = None
    for tier in reversed(tiers):
        below = tier.where("n = 1").join(tops, "tree").select("tree", "pos", "n", "digest", "path")
        if placed is not None:
            block = F.expr(f"pos div {FAN**height}").alias("block")
            many = tier.where("n > 1").select("*", block).groupBy("tree", "block")
            outer = placed.select("tree", F.col("pos").alias("block"), "path").groupBy("tree", "block")
            below = below.unionByName(many.cogroup(outer).applyInPandas(lambda a, b: _place(a, b, height), _PLACED))
        placed = materialize(below, "merkle-paths")
    return placed


def _nothing(schema: str) -> pd.DataFrame:
    return pd.DataFrame({part.split()[0]: [] for part in schema.split(", ")})


_PROVEN = (
    "key string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
)


def _finish(leaves: pd.DataFrame, outer: pd.DataFrame, height: int) -> pd.DataFrame:
    """Local levels, proofs and folding of the superblocks of one group."""
    above = {(o.tree, o.pos): o for o in outer.itertuples(index=False)}
    rows, span = [], FAN**height
    for (tree, block), part in leaves.groupby(["tree", leaves["pos"] // span]):
        part = part.sort_values("pos")
        siblings = siblings_of(levels_of(part["digest"].tolist(), int(part["n"].iloc[0]) <= span, height))
        top = above[(tree, block)]
        beyond = read_path(top.path)
        for i, (key, leaf, other) in enumerate(zip(part["key"], part["digest"], part["changed"], strict=True)):
            path = path_of(siblings, i) + beyond
            proof = digest_of(*[side for level in path for side in level])
            folded = fold(other or leaf, path)
            rows.append((key, leaf, top.subroot, top.root, proof, folded, folded == top.root))
    return pd.DataFrame(rows, columns=[p.split()[0] for p in _PROVEN.split(", ")])


def _positions(leaves: DataFrame, height: int) -> DataFrame:
    """Leaves with their tree, place in it and its size; the tree is named by the place of its first leaf.

    Sources are joined by range chunk and source, so a hot source is spread over its chunks.
    """
    chunked = ordered_chunks(leaves, ["source", "doc_id", "digest"])
    parts = chunked.groupBy("chunk", "source").agg(F.count("*").alias("rows"), F.min("chunk_pos").alias("first"))
    parts = parts.join(F.broadcast(chunk_offsets(chunked)), "chunk")  # one row per chunk, bounded by `ordered_chunks`
    parts = parts.select("chunk", "source", "rows", "offset", (F.col("offset") + F.col("first")).alias("at"))
    parts = materialize(parts, "merkle-parts")
    trees = parts.groupBy("source").agg(F.min("at").alias("tree"), F.sum("rows").alias("n"))
    named = parts.alias("p").join(trees.alias("t"), F.expr("p.source <=> t.source"))
    named = named.selectExpr("p.chunk AS in_chunk", "p.source AS of_source", "p.offset", "t.tree", "t.n")
    both = chunked.join(named, F.expr("chunk = in_chunk AND source <=> of_source"))
    pos = F.col("offset") + F.col("chunk_pos") - F.col("tree")
    return both.select(
        F.col("doc_id").cast("string").alias("key"), "digest", "changed", "tree", "n", pos.alias("pos")
    ).withColumn("pack", _pack(F.expr(f"pos div {FAN**height}"), height))


def _pack(block: Column, height: int) -> Column:
    """Group of a superblock: superblocks that begin within the same span of the table meet."""
    begin = F.col("tree") + block * FAN**height
    return begin - begin % FAN**height


def prove(df: DataFrame, changed=without_line_breaks, height: int = LEVELS) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and what its proof makes of the changed row.

    `changed` gives the leaf of the row as it is found later, null where it is untouched. A superblock
    has `height` levels. Texts are hashed where they are read; only digests are moved.
    """
    ship_package(df.sparkSession)
    leaves = materialize(
        df.select("doc_id", "source", leaf_of(df).alias("digest"), changed(df).alias("changed")), "merkle-leaves"
    )
    placed = materialize(_positions(leaves, height), "merkle-placed")
    lowest = placed.select("pack", "tree", "pos", "n", "digest").groupBy("pack")
    lowest = materialize(lowest.applyInPandas(lambda pdf: _reduce(pdf, height), _NODE), "merkle-tier")
    tiers = _reduce_up(lowest, height)
    tops, root = _above_sources(tiers, height)
    outer = _path_down(tiers, tops.select("tree", "path"), height).join(tops.select("tree", "subroot"), "tree")
    outer = outer.select("tree", "pos", "path", "subroot", F.lit(root).cast("string").alias("root"))
    outer = outer.withColumn("pack", _pack(F.col("pos"), height))
    proven = placed.groupBy("pack").cogroup(outer.groupBy("pack"))
    return proven.applyInPandas(lambda a, b: _finish(a, b, height), _PROVEN).select(
        F.col("key").cast(df.schema["doc_id"].dataType).alias("doc_id"),
        "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified",
    )


def _above_sources(tiers: list[DataFrame], height: int) -> tuple[DataFrame, str | None]:
    """Subroot of every tree with its path to the root, and the root, one digest."""
    subroots = tiers[0].where("n = 1")
    for tier in tiers[1:]:
        subroots = subroots.unionByName(tier.where("n = 1"))
    subroots = materialize(with_position(subroots.select("tree", "digest"), ["tree"], "place"), "merkle-subroots")
    none, n = F.lit(0).cast("bigint").alias("tree"), F.lit(subroots.count()).cast("bigint").alias("n")
    upper = _reduce_up(subroots.select(none, F.col("place").alias("pos"), n, "digest"), height)
    last = upper[-1].first()
    paths = _path_down(upper, upper[-1].select("tree", F.lit("").alias("path")), height)
    tops = subroots.join(paths.select(F.col("pos").alias("place"), "path"), "place")
    tops = tops.select("tree", F.col("digest").alias("subroot"), "path")
    return materialize(tops, "merkle-tops"), last["digest"] if last else None
