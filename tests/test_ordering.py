import random

import pytest
from pyspark.sql import functions as F

from inkwell.operators.breaker import breaker_trips, failure_streaks, longest_streaks
from inkwell.operators.infer import Breaker
from inkwell.operators.ordering import first_n, first_n_in_files, with_file_position, with_position
from inkwell.operators.resume import pending
from inkwell.operators.shard import contiguous_by_key, select_shard, shard_sizes, with_shard


def test_positions_follow_the_order_also_for_a_hot_value(spark):
    random.seed(2)
    keys = ["hot"] * 400 + [f"k{random.randint(0, 10**6)}" for _ in range(600)]
    random.shuffle(keys)
    rows = spark.createDataFrame([(k,) for k in keys], "k string").repartition(5)
    got = sorted((r.position, r.k) for r in with_position(rows, ["k"], chunks=16).collect())
    assert [p for p, _ in got] == list(range(1000))
    assert [k for _, k in got] == sorted(keys)


def test_contiguous_blocks_split_a_hot_key(spark):
    rows = spark.createDataFrame([("hot",)] * 50 + [(f"z{i:02d}",) for i in range(53)], "id string")
    got = contiguous_by_key(rows, 4).groupBy("shard").count().orderBy("shard").collect()
    assert [r["count"] for r in got] == [26, 26, 26, 25]


@pytest.fixture
def folder(spark, out):
    spark.range(100).select(F.col("id"), (F.col("id") * 7 % 100).alias("v")).repartition(6, "id").write.parquet(out)
    return out


def test_stored_positions(spark, folder):
    rows = spark.read.parquet(folder)
    placed = with_file_position(rows.select("id", "_metadata"))
    got = placed.select("position", "_metadata.file_path", "_metadata.row_index").orderBy("position").collect()
    assert [r.position for r in got] == list(range(100))
    assert [(r.file_path, r.row_index) for r in got] == sorted((r.file_path, r.row_index) for r in got)
    assert first_n_in_files(rows, 17).count() == 17


@pytest.mark.parametrize("mode", ["hash", "contiguous", "file"])
def test_shards_partition_the_input(spark, folder, mode):
    rows = spark.read.parquet(folder)
    placed = with_shard(rows, 3, mode)
    assert sorted(r.id for r in placed.collect()) == list(range(100))
    parts = [select_shard(placed, s, 3).count() for s in range(3)]
    assert sum(parts) == 100
    if mode == "contiguous":
        assert parts == [34, 33, 33]
    assert [r.num_rows for r in shard_sizes(placed, 3).orderBy("shard").collect()] == parts


def test_file_shards_take_whole_files_round_robin(spark, folder):
    rows = spark.read.parquet(folder)
    placed = with_shard(rows.select("id", "_metadata"), 4, "file")
    per_file = placed.groupBy("_metadata.file_path").agg(F.collect_set("shard").alias("s")).orderBy("file_path").collect()
    assert [r.s for r in per_file] == [[i % 4] for i in range(len(per_file))]
    with pytest.raises(ValueError, match="more shards"):
        with_shard(rows, 100, "file")


def test_unknown_mode(spark, folder):
    with pytest.raises(ValueError):
        with_shard(spark.read.parquet(folder), 3, "random")


@pytest.mark.parametrize("n", [0, 1, 40, 100, 500])
def test_first_n(spark, folder, n):
    rows = spark.read.parquet(folder)
    assert sorted(r.id for r in first_n(rows, n, "id").collect()) == list(range(min(n, 100)))


@pytest.mark.parametrize("n", [3, 5, 20, 200])
def test_first_n_counts_nulls_first(spark, n):
    rows = spark.createDataFrame([(None,)] * 5 + [(i,) for i in range(95)], "id int")
    got = [r.id for r in first_n(rows, n, "id").collect()]
    assert len(got) == min(n, 100) and got.count(None) == min(n, 5)
    assert sorted(i for i in got if i is not None) == list(range(min(n, 100) - got.count(None)))


def test_first_n_keeps_exactly_n_among_ties(spark):
    rows = spark.createDataFrame([(1,)] * 5 + [(2,)] * 50 + [(3,)] * 5, "id int")
    got = [r.id for r in first_n(rows, 20, "id").collect()]
    assert sorted(got) == [1] * 5 + [2] * 15


def test_pending_and_done_make_the_input(spark):
    rows = spark.range(50).select(F.col("id").cast("string").alias("id"))
    done = rows.where("id % 3 = 0").select("id")
    rest = pending(rows, done)
    assert sorted(r.id for r in rest.union(done).collect()) == sorted(str(i) for i in range(50))
    assert pending(rows.withColumnRenamed("id", "key"), done, "key").count() == rest.count()


KINDS = {"ok": ("ok", None), "api": ("error", "api"), "timeout": ("error", "timeout"), "long": ("error", "context_length"),
         "other": ("error", "other")}


def random_log(seed, shards=3, rows=300):
    random.seed(seed)
    log = []
    for i in range(rows):
        shard = 0 if random.random() < 0.6 else random.randrange(shards)
        kind = random.choices(list(KINDS), [1, 4, 2, 1, 1])[0]
        log.append((f"{i:04d}", shard, random.randrange(rows // 3), *KINDS[kind]))
    return log


@pytest.mark.parametrize("seed, chunks", [(1, 1), (2, 7), (3, 40)])
def test_streaks_agree_with_a_plain_counter(spark, seed, chunks):
    log = random_log(seed)
    frame = spark.createDataFrame(log, "id string, shard int, at int, status string, error_class string").withColumn(
        "finished_at", F.timestamp_seconds("at")
    )
    first, longest = {}, {}
    for shard in range(3):
        breaker = Breaker(4)
        for row_id, _, at, status, kind in sorted((r for r in log if r[1] == shard), key=lambda r: (r[2], r[0])):
            was = breaker.tripped
            breaker.record(status, kind)
            if breaker.tripped and not was:
                first[shard] = row_id
            if kind in ("api", "timeout"):
                longest[shard] = max(longest.get(shard, 0), breaker.streak)
    assert {r.shard: r.id for r in breaker_trips(frame, 4, chunks=chunks).collect()} == first
    assert {r.shard: r.longest_streak for r in longest_streaks(frame, chunks=chunks).collect()} == longest


def test_a_streak_spans_many_chunks(spark):
    frame = spark.range(500).select(
        F.lpad(F.col("id").cast("string"), 4, "0").alias("id"),
        F.lit(0).alias("shard"),
        F.timestamp_seconds("id").alias("finished_at"),
        F.when(F.col("id") == 0, "ok").otherwise("error").alias("status"),
        F.when(F.col("id") > 0, "timeout").alias("error_class"),
    )
    assert failure_streaks(frame, chunks=16).agg(F.max("streak")).first()[0] == 499
    assert breaker_trips(frame, 450, chunks=16).first().id == "0450"
