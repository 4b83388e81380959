"""Document fingerprints: a threshold-scaled sketch of word shingles, in column expressions only.

A fingerprint holds every five-word shingle hash below a fixed fraction of the hash range. Two
fingerprints are compared on the hashes that both would have kept, so a short text can be held
against a very long one; the union of two fingerprints, cut below the threshold, is the
fingerprint of both texts' shingles together. A text with fewer than `FLOOR` hashes below the
fraction keeps its `FLOOR` least ones (all, if it has fewer); its threshold is then the
largest of them.

Defined cases: a null text counts as empty; an empty text has an empty fingerprint, is like
another empty one (1.0) and unlike all others (0.0); a text of one to four words is one shingle;
repeated shingles count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = " \t\n\u000b\f\r"
WORDS = 5
FRACTION = 8  # one hash in eight
THRESHOLD = -(2**31) + 2**32 // FRACTION  # of the upper 32 bits, as a signed number
FLOOR = 16
LEAST, MOST = -(2**63), 2**31 - 1
BUCKETS = 1024


def words(text: Column) -> Column:
    """Words of a text, a single empty one if there is none."""
    return F.split(F.trim(F.lower(text), F.lit(SPACE)), r"[\x20\x09-\x0D]+")


def shingle_hashes(word_list: Column, n: int = WORDS) -> Column:
    """Hashes of n words in a row. `word_list` has to be a plain column."""
    places = F.sequence(F.lit(0), F.greatest(F.size(word_list) - n, F.lit(0)))
    # get() beyond the end is null, which the hash passes over
    hashed = F.transform(
        places, lambda i: F.shiftright(F.xxhash64(*[F.get(word_list, i + j) for j in range(n)]), 32).cast("int")
    )
    empty = (F.size(word_list) == 1) & (word_list[0] == "")
    return F.when(empty, F.array().cast("array<int>")).otherwise(hashed)


def sketch_of(hashes: Column) -> Column:
    """The hashes that are kept. `hashes` has to be a plain column."""
    low = F.array_distinct(F.filter(hashes, lambda h: h < THRESHOLD))
    few = F.slice(F.sort_array(F.array_distinct(hashes)), 1, FLOOR)
    return F.when(F.size(low) >= FLOOR, F.sort_array(low)).otherwise(few)


def with_sketch(df: DataFrame, text: str, to: str) -> DataFrame:
    """Add the sketch of a text column, an ascending array<int>."""
    return (
        df.withColumn("__words", words(F.coalesce(F.col(text), F.lit(""))))
        .withColumn("__hashes", shingle_hashes(F.col("__words")))
        .withColumn(to, sketch_of(F.col("__hashes")))
        .drop("__words", "__hashes")
    )


def threshold(sketch: Column) -> Column:
    """Largest hash that the sketch would have kept."""
    return F.when(F.size(sketch) < FLOOR, F.lit(MOST)).otherwise(
        F.greatest(F.element_at(sketch, -1), F.lit(THRESHOLD - 1))
    )


def compare(df: DataFrame, a: str, b: str, likeness: str, containment: str | None = None) -> DataFrame:
    """Add estimates of the share of common shingles, and of the share of a's that b holds."""
    cut = F.least(threshold(F.col(a)), threshold(F.col(b)))
    cut_a, cut_b = (F.filter(F.col(c), lambda h: h <= F.col("__cut")) for c in (a, b))
    both_empty = (F.size(a) == 0) & (F.size(b) == 0)
    common, size_a, size_b = F.col("__common"), F.size("__a"), F.size("__b")
    out = (
        df.withColumn("__cut", cut)
        .withColumns({"__a": cut_a, "__b": cut_b})
        .withColumn("__common", F.size(F.array_intersect("__a", "__b")))
        .withColumn(
            likeness,
            F.when(both_empty, 1.0).when(size_a + size_b == 0, 0.0).otherwise(common / (size_a + size_b - common)),
        )
    )
    if containment:
        out = out.withColumn(containment, F.when(both_empty, 1.0).when(size_a == 0, 0.0).otherwise(common / size_a))
    return out.drop("__cut", "__a", "__b", "__common")


def merge(a: Column, b: Column) -> Column:
    """Sketch of the shingles of two texts together."""
    cut = F.least(threshold(a), threshold(b))
    return F.sort_array(F.filter(F.array_union(a, b), lambda h: h <= cut))


def as_text(sketch: Column) -> Column:
    return F.concat_ws(" ", sketch.cast("array<string>"))


def next_keys(keys: DataFrame) -> DataFrame:
    """(key, content, take, next_key, next_content): each row's successor, the first after the last.

    Only these narrow rows are ordered. Buckets follow quantiles of the key; at most `BUCKETS`
    rows, the first of each bucket, meet in one task.
    """
    steps = [i / BUCKETS for i in range(1, BUCKETS)]
    count, quantiles = keys.agg(F.count("*"), F.percentile_approx("key", steps, 10 * BUCKETS)).first()
    wanted = min(BUCKETS, max(1, count // 4096))
    bounds = sorted({quantiles[i * BUCKETS // wanted - 1] for i in range(1, wanted)}) if quantiles else []
    # a balanced tree of comparisons, ten deep at most
    place = _search(F.col("key"), bounds, 0)
    rows = keys.withColumn("bucket", place)
    order = F.struct("key", "content")
    heads = rows.groupBy("bucket").agg(F.min(order).alias("head"))
    all_heads = Window.partitionBy(F.lit(0)).orderBy("bucket")
    heads = heads.select(
        "bucket",
        F.coalesce(F.lead("head").over(all_heads), F.first("head").over(all_heads)).alias("after"),
    )
    within = Window.partitionBy("bucket").orderBy("key", "content")
    paired = rows.withColumn("following", F.lead(order).over(within)).join(F.broadcast(heads), "bucket")
    after = F.coalesce("following", "after")
    return paired.select(
        "key", "content", "take", after["key"].alias("next_key"), after["content"].alias("next_content")
    )


def _search(key: Column, bounds: list[int], base: int) -> Column:
    if not bounds:
        return F.lit(base)
    middle = len(bounds) // 2
    return F.when(key < bounds[middle], _search(key, bounds[:middle], base)).otherwise(
        _search(key, bounds[middle + 1 :], base + middle + 1)
    )


def fingerprint_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit with the next document, and their likeness.

    The edit replaces the last quarter of the code points by the beginning of the next document
    in order of (id, content); rows equal in both share their successor, a null id comes first.
    A document is shuffled once, and a quarter's worth of its text and its fingerprint once more.
    """
    rows = docs.select(
        F.coalesce(docs[doc_id].cast("bigint"), F.lit(LEAST)).alias("key"),
        F.coalesce(docs[text], F.lit("")).alias("text"),
    ).withColumn("content", F.xxhash64("text"))
    narrow = rows.select("key", "content", F.floor(F.length("text") / 4).cast("int").alias("take")).distinct()
    pairs = next_keys(narrow)
    sketched = with_sketch(rows, "text", "sketch")
    following = (
        sketched.alias("b")
        .join(pairs.alias("p"), (F.col("b.key") == F.col("p.next_key")) & (F.col("b.content") == F.col("p.next_content")))
        .groupBy(F.col("p.key").alias("p_key"), F.col("p.content").alias("p_content"))
        .agg(
            F.first(F.substr("b.text", F.lit(1), F.col("p.take"))).alias("beginning"),
            F.first("b.sketch").alias("next_sketch"),
        )
    )
    joined = sketched.join(following, (F.col("key") == F.col("p_key")) & (F.col("content") == F.col("p_content")))
    n = F.length("text")
    edited = F.concat(F.substr("text", F.lit(1), n - F.floor(n / 4).cast("int")), F.col("beginning"))
    whole = joined.select(
        F.when(F.col("key") != LEAST, F.col("key")).alias("doc_id"),
        n.cast("bigint").alias("n_chars"),
        "sketch",
        "next_sketch",
        edited.alias("edited"),
    )
    whole = with_sketch(whole, "edited", "edited_sketch")
    whole = compare(whole, "sketch", "edited_sketch", "near_edited", "contained_in_edited")
    whole = compare(whole, "sketch", "next_sketch", "near_next", "contained_in_next")
    return whole.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        "contained_in_edited",
        "contained_in_next",
    )
