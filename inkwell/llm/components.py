"""Connected components of a link table, by joins over narrow rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.session import materialize

FOREST_NODES = 500_000
LINKS_PER_TASK = 50_000
_LINK = "a bigint, b bigint"


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (root, node) that join what the links of this task join; memory is bounded."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def out() -> Iterator[pa.RecordBatch]:
        pairs = [(find(x), x) for x in parent]
        pairs = [p for p in pairs if p[0] != p[1]]
        parent.clear()
        if pairs:
            a, b = zip(*pairs, strict=True)
            yield pa.record_batch([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > FOREST_NODES:
            yield from out()
    yield from out()


def spanning(links: DataFrame, name: str = "components") -> DataFrame:
    """Fewer links with the same components.

    Links go to tasks by the smallest neighbour of their larger end, which most links of a dense
    group share; each task passes on a forest. A dense group that many tasks saw a part of is thinned again, by
    fewer tasks each time, until a pass leaves most links in place.
    """
    ordered = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b")
    least = ordered.withColumn("least", F.min("a").over(Window.partitionBy("b")))
    thin = materialize(least.repartition("least").select("a", "b").mapInArrow(_forest, _LINK), f"{name}-thin")
    many = thin.count()
    while many > LINKS_PER_TASK // 10:
        packed = thin.coalesce(-(-many // LINKS_PER_TASK)).mapInArrow(_forest, _LINK)
        thin = materialize(packed.distinct(), f"{name}-thin")
        before, many = many, thin.count()
        if 10 * many > 7 * before:
            break
    return thin


def _priority(node: Column) -> Column:
    """A fixed random order of nodes: it keeps contracted trees short however ids run along a chain."""
    return F.struct(F.xxhash64(node).alias("order"), node.alias("node"))


def _contract(links: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(node, to) for every node, its first neighbour or itself, and the links between those."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = both.groupBy("a").agg(F.min(_priority(F.col("b"))).alias("first"))
    to = F.least(_priority(F.col("a")), F.col("first"))["node"]
    moved = materialize(first.select(F.col("a").alias("node"), to.alias("to")), f"{name}-moved")
    left = moved.select(F.col("node").alias("a"), F.col("to").alias("x"))
    right = moved.select(F.col("node").alias("b"), F.col("to").alias("y"))
    fewer = links.join(left, "a").join(right, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return moved, spanning(fewer, name)


def connected(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): the smallest node that each node of `links` (a, b) reaches.

    While there are more links than a task takes, every node moves to the first of its neighbours in a random order,
    which leaves a fraction of the nodes and links for the next round; all rounds together handle a small multiple of the
    links. What is left, at most `LINKS_PER_TASK` links, one task joins. Then rounds are undone, last one first.
    A node with very many links is pre-aggregated before its rows are shuffled.
    """
    left, rounds = spanning(links, name), []
    while left.count() > LINKS_PER_TASK:
        moved, left = _contract(left, name)
        rounds.append(moved)
    joined = left.coalesce(1).mapInArrow(_forest, _LINK).select(F.col("b").alias("node"), F.col("a").alias("root"))
    labels = joined.unionByName(joined.select(F.col("root").alias("node"), "root").distinct())
    labels = materialize(labels, name)
    if not rounds:
        return labels
    for moved in reversed(rounds):
        known = labels.select(F.col("node").alias("to"), "root")
        labels = moved.join(known, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
        labels = materialize(labels, name)
    least = labels.groupBy("root").agg(F.min("node").alias("least"))
    return materialize(labels.join(least, "root").select("node", F.col("least").alias("root")), name)
