"""N-gram Jaccard join: near-copies as connected groups, by blocked products of the incidence matrix.

A document is the set of its five-word shingles; two link when they share enough of their union.
Equal sets are one node from the start. Candidates come from size bounds: in any fixed order of
shingles, two sets that link share one among their first ones (a fifth of the set), and so many
of them that the rest could still reach the needed overlap. The order puts shingles of many documents last, so
that common lines bring no candidates. Groups of candidates are then multiplied: blocks of the
document-by-shingle matrix, tile by tile, give exact overlaps; tiles whose sizes cannot link, or
whose documents are linked already, are passed over. Only the spanning links leave a task.

Which shingles are common is counted on one document in eight, by a hash of the id. This decides
the order alone; any order gives the same links.

Defined cases: a null or empty text has no shingles and is its own component; a text of one to
four words is one shingle, its whole sequence; rows that repeat an id are judged each by their
own text, and a component's name is its smallest id; a null id has a component if another
document links to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.components import connected
from inkwell.llm.words import as_signed, mix, runs, shingles, words_of
from inkwell.session import materialize
from inkwell.sources.shipping import ship_package

PERCENT = 80
WORDS = 5
SAMPLE, SEEN = 8, 4  # common: at least four times in one document of eight
BITS = 26  # of the table of common shingles, 8 MB whatever the data
BUCKET = 64  # larger buckets bring chains instead of pairs; their groups are multiplied whole
BLOCK = 1 << 22  # hashes in a block
TILE_ROWS, TILE_HASHES = 256, 1 << 16
_TOP = np.uint64(1 << 63)


def needed(size: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Least overlap of two linked sets of these sizes."""
    return -(-PERCENT * (size + other) // (100 + PERCENT))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of a run of texts, ordered by text and hash."""
    text, hashed = shingles(words_of(data, offsets), WORDS)
    order = np.lexsort((hashed, text))
    text, hashed = text[order], hashed[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (hashed[1:] != hashed[:-1])
    return text[new], hashed[new]


def _signatures(text: np.ndarray, hashed: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A node key per set: a hash of its members in any order."""
    total = np.zeros(len(size), dtype=np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        first = np.concatenate([[0], np.cumsum(size[some])[:-1]])
        total[some] = np.add.reduceat(mix(hashed ^ np.uint64(0x5851F42D4C957F2D)), first)
    return mix(total + size.astype(np.uint64))


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def common_shingles(docs: DataFrame) -> np.ndarray:
    """A fixed table of bits, set for shingles of many documents."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in runs(batch.column(0)):
                yield pa.record_batch([pa.array(as_signed(shingle_sets(data, offsets)[1]))], names=["shingle"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text")
    often = sample.mapInArrow(hashes, "shingle bigint").groupBy("shingle").count().where(F.col("count") >= SEEN)
    place = F.shiftrightunsigned("shingle", 64 - BITS)
    word, bit = F.shiftright(place, 6), F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(63).cast("int")
    )
    # at most 2 ** (BITS - 6) rows
    rows = often.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    table = np.zeros(1 << (BITS - 6), dtype=np.int64)
    for part in rows.toArrow().to_batches():
        table[part.column(0).to_numpy()] = part.column(1).to_numpy()
    return table.view(np.uint64)


def _ordered(hashed: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Shingles as signed numbers whose order puts common ones last."""
    place = hashed >> np.uint64(64 - BITS)
    common = (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1)
    return as_signed(((hashed >> np.uint64(1)) | (common << np.uint64(63))) ^ _TOP)


def content_of(text: Column) -> Column:
    """Tells rows of one id apart."""
    return F.xxhash64(text)


def nodes_of(docs: DataFrame, table) -> DataFrame:
    """(doc_id, content, node, n, first): each document's set key, its size and its first shingles in order."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in runs(batch.column(1)):
                text, hashed = shingle_sets(data, offsets)
                size = np.bincount(text, minlength=hi - lo)
                node = _signatures(text, hashed, size)
                key = _ordered(hashed, table.value)
                order = np.lexsort((key, text))
                key = key[order]
                rank = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
                prefix = np.where(size > 0, size - -(-PERCENT * size // 100) + 1, 0)
                kept = rank < np.repeat(prefix, size)
                ids, contents = (batch.column(i).slice(lo, hi - lo) for i in (0, 2))
                yield pa.record_batch(
                    [ids, contents, pa.array(as_signed(node)), pa.array(size), _lists(key[kept], prefix)],
                    names=["doc_id", "content", "node", "n", "first"],
                )

    return docs.select("doc_id", "text", content_of(docs["text"])).mapInArrow(
        read, "doc_id bigint, content bigint, node bigint, n bigint, first array<bigint>"
    )


def _pairs_of(shingle, node, n, last) -> list[np.ndarray]:
    """(a, b, least count) of all pairs within runs of equal shingles."""
    rest = n - (n - -(-PERCENT * n // 100) + 1)  # shingles behind the first ones
    out = []
    for d in range(1, BUCKET):
        if len(shingle) <= d:
            break
        i = np.flatnonzero(shingle[d:] == shingle[:-d])
        if not len(i):
            break
        j = i + d
        fits = 100 * n[i] >= PERCENT * n[j]  # sizes ascend in a run
        i, j = i[fits], j[fits]
        # behind the earlier end of the two nothing is known but the number of shingles left
        behind = np.where(last[i] <= last[j], rest[i], rest[j])
        least = np.maximum(1, needed(n[i], n[j]) - behind)
        out.append(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), least]))
    return out


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of small buckets and chains of large ones, from rows sorted by shingle, size and node.

    Rows flow through; at most a bucket of `BUCKET` rows is held back.
    """
    carry = np.zeros((4, 0), dtype=np.int64)
    large, large_last = None, None

    def emit(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if parts:
            a, b, least = np.concatenate(parts, axis=1)
            yield pa.record_batch([pa.array(a), pa.array(b), pa.array(least)], names=["a", "b", "least"])

    def chain(first, nodes) -> np.ndarray:
        ends = np.concatenate([[first], nodes]) if first is not None else nodes
        a, b = ends[:-1], ends[1:]
        return np.stack([np.minimum(a, b), np.maximum(a, b), np.zeros(len(a), dtype=np.int64)])

    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy() for i in range(4)])
        parts: list[np.ndarray] = []
        if large is not None:  # the rest of a large bucket
            end = int(np.searchsorted(rows[0], large, "right"))
            if end:
                parts.append(chain(large_last, rows[1, :end]))
                large_last = rows[1, end - 1]
                rows = rows[:, end:]
        rows = np.concatenate([carry, rows], axis=1)
        if not rows.shape[1]:
            yield from emit(parts)
            continue
        starts = np.flatnonzero(np.concatenate([[True], rows[0, 1:] != rows[0, :-1]]))
        length = np.diff(np.append(starts, rows.shape[1]))
        open_run = rows[:, starts[-1] :]
        closed, carry = rows[:, : starts[-1]], open_run
        if open_run.shape[1] > BUCKET:
            parts.append(chain(None, open_run[1]))
            large, large_last = open_run[0, 0], open_run[1, -1]
            carry = open_run[:, :0]
        for s, m in zip(starts[:-1][length[:-1] > BUCKET].tolist(), length[:-1][length[:-1] > BUCKET].tolist(), strict=True):
            parts.append(chain(None, closed[1, s : s + m]))
        small = np.repeat((length[:-1] > 1) & (length[:-1] <= BUCKET), length[:-1])
        parts += _pairs_of(*closed[:, small])
        yield from emit(parts)
    yield from emit(_pairs_of(*carry))


def candidate_links(nodes: DataFrame) -> DataFrame:
    """(a, b) that may link, or lie in one chain of a large bucket."""
    first = (
        nodes.where("n > 0")
        .select("node", "n", "first")
        .dropDuplicates(["node"])  # equal sets have equal first shingles
        .select("node", "n", "first", F.element_at("first", -1).alias("last"))
        .select(F.explode("first").alias("shingle"), "node", "n", "last")
    )
    found = (
        first.repartition("shingle")
        .sortWithinPartitions("shingle", "n", "node")
        .mapInArrow(_bucket_links, "a bigint, b bigint, least bigint")
        .where("a != b")
    )
    counted = found.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("least").alias("least"))
    return counted.where("shared >= least").select("a", "b")


def _blocks(groups: DataFrame) -> DataFrame:
    """(node, left, right, group): the block pairs that need a node.

    A group's documents are ordered by size and cut into blocks of `BLOCK` hashes; pairs of blocks whose
    sizes cannot link are left out.
    """
    order = Window.partitionBy("group").orderBy("n", "node")
    placed = groups.withColumn(
        "block", F.floor((F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1) / BLOCK)
    )
    ranges = placed.groupBy("group", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    left, right = ranges.alias("l"), ranges.alias("r")
    pairs = left.join(
        right,
        (F.col("l.group") == F.col("r.group"))
        & (F.col("l.block") <= F.col("r.block"))
        & (100 * F.col("l.high") >= PERCENT * F.col("r.low")),
    ).select(F.col("l.group").alias("group"), F.col("l.block").alias("left"), F.col("r.block").alias("right"))
    sides = pairs.select("group", "left", "right", F.col("left").alias("block")).unionByName(
        pairs.where("left < right").select("group", "left", "right", F.col("right").alias("block"))
    )
    return placed.join(sides, ["group", "block"]).select("node", "group", "left", "right")


def block_links(sets: list[np.ndarray], roots: np.ndarray) -> np.ndarray:
    """Roots after linking documents (ordered by size) by exact overlap: the blocked product."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)
    shared = times[column] > 1
    column, owner = column[shared], owner[shared]
    first = np.searchsorted(owner, np.arange(len(sets) + 1))
    parent = roots.copy()

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    cuts = [0]
    weight = np.concatenate([[0], np.cumsum(size)])
    while cuts[-1] < len(sets):
        end = int(np.searchsorted(weight, weight[cuts[-1]] + TILE_HASHES, "right")) - 1
        cuts.append(min(len(sets), max(cuts[-1] + 1, min(end, cuts[-1] + TILE_ROWS))))
    tiles = list(zip(cuts[:-1], cuts[1:], strict=True))

    def dense(lo: int, hi: int, columns: np.ndarray) -> np.ndarray:
        c, r = column[first[lo] : first[hi]], owner[first[lo] : first[hi]] - lo
        at = np.minimum(np.searchsorted(columns, c), max(0, len(columns) - 1))
        has = columns[at] == c if len(columns) else np.zeros(len(c), dtype=bool)
        out = np.zeros((hi - lo, len(columns)), dtype=np.float32)
        out[r[has], at[has]] = 1
        return out

    distinct = [np.unique(column[first[lo] : first[hi]]) for lo, hi in tiles]
    for gap in range(len(tiles)):
        for x in range(len(tiles) - gap):
            (lo, hi), (other_lo, other_hi) = tiles[x], tiles[x + gap]
            if 100 * size[hi - 1] < PERCENT * size[other_lo]:
                continue
            mine = np.array([find(i) for i in range(lo, hi)])
            theirs = np.array([find(i) for i in range(other_lo, other_hi)])
            if mine.min() == mine.max() == theirs.min() == theirs.max():
                continue  # linked already
            columns = np.intersect1d(distinct[x], distinct[x + gap], assume_unique=True)
            if not len(columns):
                continue
            overlap = np.rint(dense(lo, hi, columns) @ dense(other_lo, other_hi, columns).T).astype(np.int64)
            total = size[lo:hi, None] + size[None, other_lo:other_hi]
            link = (overlap > 0) & (100 * overlap >= PERCENT * (total - overlap))
            for i, j in zip(*_spanning(link, mine, theirs), strict=True):
                a, b = find(int(i)), find(int(j))
                if a != b:
                    parent[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(len(sets))])


def _spanning(link: np.ndarray, mine: np.ndarray, theirs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of roots that a tile's links join; as few as its rows and columns."""
    a, b = mine.copy(), theirs.copy()
    top = np.iinfo(np.int64).max
    while True:
        low_a = np.minimum(a, np.where(link, b[None, :], top).min(axis=1))
        low_b = np.minimum(b, np.where(link, low_a[:, None], top).min(axis=0))
        if (low_a == a).all() and (low_b == b).all():
            break
        a, b = low_a, low_b
    return np.concatenate([mine, theirs]), np.concatenate([a, b])


def _multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of block pairs, from rows sorted by (group, left, right, n, node)."""
    key, nodes, sets = None, [], []

    def finish() -> Iterator[pa.RecordBatch]:
        if len(sets) > 1:
            root = block_links(sets, np.arange(len(sets)))
            node = np.array(nodes)
            moved = np.flatnonzero(root != np.arange(len(sets)))
            if len(moved):
                yield pa.record_batch([pa.array(node[root[moved]]), pa.array(node[moved])], names=["a", "b"])

    for batch in batches:
        keys = list(zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True))
        node = batch.column(3).to_pylist()
        values = batch.column(4).flatten().to_numpy()
        ends = np.cumsum(batch.column(4).value_lengths().to_numpy())
        begin = 0
        for k, v, end in zip(keys, node, ends.tolist(), strict=True):
            if k != key:
                yield from finish()
                key, nodes, sets = k, [], []
            nodes.append(v)
            sets.append(values[begin:end].copy())
            begin = end
    yield from finish()


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, hashes) of the wanted (doc_id, content, node); ids may be null."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column(1).to_numpy()
            for lo, hi, data, offsets in runs(batch.column(2)):
                text, hashed = shingle_sets(data, offsets)
                size = np.bincount(text, minlength=hi - lo)
                node = as_signed(_signatures(text, hashed, size))
                right = node == want[lo:hi]  # a repeated id may have other texts too
                yield pa.record_batch(
                    [pa.array(node[right]), _lists(as_signed(hashed[right[text]]), size[right])], names=["node", "hashes"]
                )

    same = docs["doc_id"].eqNullSafe(F.col("want_id")) & (content_of(docs["text"]) == F.col("want_content"))
    rows = docs.join(wanted, same).select("doc_id", "node", "text")
    return rows.mapInArrow(read, "node bigint, hashes array<bigint>").dropDuplicates(["node"])


def labelled(docs: DataFrame, small: int = 1_000_000) -> DataFrame:
    """(doc_id, content, n, root) of every row of `docs` (doc_id, text); rows of one component share a root.

    `small`: up to so many documents (24 bytes each) in candidate groups are sent to every executor
    to pick their texts; more are joined by a shuffle.
    """
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"])
    table = spark.sparkContext.broadcast(common_shingles(docs))
    nodes = materialize(nodes_of(docs, table), "jaccard-nodes")
    candidates = connected(candidate_links(nodes), "jaccard-candidates")
    named = nodes.groupBy("node").agg(F.min(F.struct("doc_id", "content")).alias("at"), F.min("n").alias("n"))
    groups = materialize(
        candidates.join(named, "node").select(
            "node", F.col("at.doc_id").alias("want_id"), F.col("at.content").alias("want_content"), "n",
            F.col("root").alias("group"),
        ),
        "jaccard-groups",
    )
    wanted = groups.select("want_id", "want_content", "node")
    if groups.count() <= small:
        wanted = F.broadcast(wanted)
    sets = _sets_of(docs, wanted)
    tasks = sets.join(_blocks(groups.select("node", "n", "group")), "node")
    links = (
        tasks.select("group", "left", "right", "node", "hashes", F.size("hashes").alias("n"))
        .repartition("group", "left", "right")
        .sortWithinPartitions("group", "left", "right", "n", "node")
        .select("group", "left", "right", "node", "hashes")
        .mapInArrow(_multiply, "a bigint, b bigint")
    )
    roots = connected(links, "jaccard-components")
    return nodes.select("doc_id", "content", "node", "n").join(roots, "node", "left").select(
        "doc_id", "content", "n", F.coalesce("root", "node").alias("root")
    )


def later_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, content) of rows of `docs` in whose component there is a smaller (doc_id, content)."""
    rows = labelled(docs).where("n > 0 and doc_id is not null").withColumn("at", F.struct("doc_id", "content"))
    least = rows.groupBy("root").agg(F.min("at").alias("least"))
    return rows.join(least, "root").where("at != least").select("doc_id", "content").distinct()


def jaccard_components(docs: DataFrame, small: int = 1_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `docs` (doc_id, text); `small` as for `labelled`."""
    rows = labelled(docs, small).drop("content")
    least = rows.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "root", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
    )
