import os

import pytest
from pyspark.sql import functions as F

from inkwell.functions.parsing import choices, text
from inkwell.operators.outcomes import id_counts
from inkwell.operators.responses import join_back, latest_per_id, read_plain_responses, read_responses, responses
from inkwell.schemas import response_ddl, results_schema
from inkwell.sinks import compaction
from inkwell.sinks.compaction import compact, compaction_plan
from inkwell.sinks.tables import append_results, file_inventory
from inkwell.sources import files
from inkwell.sources.responses import done_ids, read_response_files, read_results


def results(spark, n, wave=0, status="ok", label="a"):
    body = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit(label), F.col("id").cast("string")).alias("text"))).alias("choices")))
    shard = F.when(F.col("id") % 3 == 0, 1).otherwise(0)
    return spark.range(n).select(
        F.col("id").cast("string").alias("id"),
        F.lit("r").alias("run_id"),
        F.lit(wave).alias("wave"),
        F.lit(status).alias("status"),
        F.lit(None).cast("string").alias("error_class"),
        F.lit(None).cast("string").alias("error_text"),
        F.lit(None).cast("int").alias("http_status"),
        F.timestamp_seconds(F.lit(100 + wave)).alias("started_at"),
        F.timestamp_seconds(F.lit(100 + wave)).alias("finished_at"),
        F.from_json(body, response_ddl("completion")).alias("response"),
        shard.alias("shard"),
    )


def texts(frame):
    return {r.id: r.t for r in frame.select("id", text().alias("t")).collect()}


def test_absent_output_is_an_empty_table(spark, out):
    empty = read_results(spark, out)
    assert empty.schema == results_schema("chat-completion") and empty.count() == 0
    assert done_ids(empty).count() == 0
    assert read_responses(spark, out).count() == 0
    assert read_plain_responses(spark, out).count() == 0
    assert file_inventory(spark, out).count() == 0


def test_last_success_wins(spark, out):
    append_results(results(spark, 30, 0), out)
    append_results(results(spark, 10, 1, label="b"), out)
    append_results(results(spark, 5, 2, status="error", label="c"), out)
    want = {str(i): ("b" if i < 10 else "a") + str(i) for i in range(30)}
    assert texts(read_responses(spark, out, "completion")) == want
    assert texts(responses(read_results(spark, out, "completion"))) == want
    counts = id_counts(read_results(spark, out, "completion")).first()
    assert (counts.num_rows, counts.num_ids, counts.surplus_rows) == (45, 30, 15)


def test_equal_copies_leave_one_row(spark, out):
    for _ in range(3):
        append_results(results(spark, 20), out)
    assert texts(read_responses(spark, out, "completion")) == {str(i): f"a{i}" for i in range(20)}


def test_latest_per_id_keeps_whole_rows(spark):
    rows = spark.createDataFrame([("a", 1, 0, "x"), ("a", 2, 0, None), ("b", 1, 0, "y")], "id string, finished_at int, wave int, v string")
    assert {r.id: (r.finished_at, r.v) for r in latest_per_id(rows).collect()} == {"a": (2, None), "b": (1, "y")}


def test_plain_files_of_both_kinds(spark, out):
    rows = results(spark, 12).select("id", "response").coalesce(1)
    for i, name in enumerate(["shard000000_checkpoint000000.parquet", "shard000000_part000000.parquet", "shard000001_part000000.parquet"]):
        part = rows.where(F.col("id") % 2 == i % 2).coalesce(1)
        part.write.parquet(f"{out}/tmp{i}")
        source = next(n for n in os.listdir(f"{out}/tmp{i}") if n.endswith(".parquet"))
        os.rename(f"{out}/tmp{i}/{source}", f"{out}/{name}")
        os.rename(f"{out}/tmp{i}", f"{out}/.tmp{i}")
    with open(f"{out}/shard000001.incomplete", "wb") as handle:
        handle.write(b"PAR1 half")
    table = read_response_files(spark, out, "completion")
    assert table.count() == 18 and sorted(r.shard for r in table.select("shard").distinct().collect()) == [0, 1]
    assert done_ids(table).count() == 12
    assert done_ids(table, shard=1).count() == 6
    assert texts(read_plain_responses(spark, out, "completion")) == {str(i): f"a{i}" for i in range(12)}
    assert {(r.shard, r.num_rows) for r in file_inventory(spark, out).collect()} == {(0, 6), (1, 6)}


def table_rows(spark, out):
    rows = read_results(spark, out, "completion").select("id", "wave", "shard", text().alias("t")).collect()
    return sorted(tuple(r) for r in rows)


def wave_files(spark, out, waves=6):
    for wave in range(waves):
        append_results(results(spark, 30, wave).coalesce(1), out)


def test_compaction_keeps_every_row(spark, out):
    wave_files(spark, out)
    before = table_rows(spark, out)
    done = compact(spark, out, max_files=5)
    assert (done.shards, done.files_before, done.files_after, done.num_rows) == ((0, 1), 12, 2, 180)
    assert table_rows(spark, out) == before
    assert file_inventory(spark, out).count() == 2
    assert [n for n in os.listdir(out) if n.startswith("_compacting")] == []
    assert compact(spark, out, max_files=5).shards == ()


def test_only_shards_over_the_limit_are_rewritten(spark, out):
    wave_files(spark, out, 5)
    assert compaction_plan(spark, out, max_files=5).count() == 0
    append_results(results(spark, 30, 5).where("shard = 1").coalesce(1), out)
    kept = {r.file_path for r in file_inventory(spark, out).where("shard = 0").collect()}
    assert compact(spark, out, max_files=5).shards == (1,)
    assert {r.file_path for r in file_inventory(spark, out).where("shard = 0").collect()} == kept


def test_row_limit_cuts_a_shard_into_files(spark, out):
    wave_files(spark, out, 8)
    before = table_rows(spark, out)
    done = compact(spark, out, max_files=5, max_rows=60)
    assert table_rows(spark, out) == before
    assert done.files_after < done.files_before
    assert all(r.num_rows <= 60 for r in file_inventory(spark, out).collect())


def test_a_stop_during_compaction_loses_nothing(spark, out, monkeypatch):
    wave_files(spark, out)
    want = texts(read_responses(spark, out, "completion"))

    def stop(*_):
        raise OSError("stopped")

    with monkeypatch.context() as stopped:
        stopped.setattr(compaction, "direct", lambda *_: None)  # files are deleted by the driver
        stopped.setattr(compaction.files, "delete_file", stop)
        with pytest.raises(OSError):
            compact(spark, out, max_files=5)
    assert spark.read.parquet(out).count() == 360  # to a plain reader rows are there twice for a while
    assert read_results(spark, out, "completion").count() == 180  # this library's readers finish it first
    assert texts(read_responses(spark, out, "completion")) == want


def test_max_rows_per_file(spark, out):
    append_results(results(spark, 30).coalesce(1), out, max_rows_per_file=7)
    assert all(r.num_rows <= 7 for r in file_inventory(spark, out).collect())


def test_join_back(spark, out):
    append_results(results(spark, 10), out)
    rows = spark.range(15).select(F.col("id").cast("string").alias("id"))
    answers = read_responses(spark, out, "completion")
    joined = {r.id: (r.responded, r.t) for r in join_back(rows, answers, columns={"t": text()}).collect()}
    assert joined["3"] == (True, "a3") and joined["12"] == (False, None) and len(joined) == 15
    assert join_back(rows, answers, how="inner").columns == ["id", "response", "responded"]
    keyed = join_back(rows.withColumnRenamed("id", "key"), answers, "key", columns={})
    assert keyed.where("responded").count() == 10


def test_choices_keep_rows_without_any(spark):
    row = "struct<choices:array<struct<index:int>>>"
    frame = spark.createDataFrame([("a", ([(0,), (1,)],)), ("b", ([],)), ("c", None)], f"id string, response {row}")
    got = sorted((r.id, -1 if r.choice_pos is None else r.choice_pos) for r in choices(frame).collect())
    assert got == [("a", 0), ("a", 1), ("b", -1), ("c", -1)]


def test_listing_skips_hidden_files(spark, out):
    os.makedirs(f"{out}/_hidden")
    for name in ("a.parquet", "_hidden/b.parquet", ".c.parquet", "d.incomplete"):
        open(f"{out}/{name}", "w").close()
    assert [n.rsplit("/", 1)[-1] for n, _ in files.list_files(spark, out)] == ["a.parquet"]
    assert files.has_file(spark, out) and not files.has_file(spark, out, "*.orc")


def test_compaction_of_a_path_with_a_space(spark, tmp_path):
    out = str(tmp_path / "a table 100%")
    wave_files(spark, out)
    before = table_rows(spark, out)
    assert compact(spark, out, max_files=5).files_after == 2
    assert table_rows(spark, out) == before and file_inventory(spark, out).count() == 2
