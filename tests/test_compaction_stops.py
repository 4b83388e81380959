"""A compaction that is stopped between any two of its steps leaves the same rows."""

import os

import pytest
from pyspark.sql import functions as F

from inkwell.schemas import response_ddl
from inkwell.sinks import compaction
from inkwell.sinks.compaction import compact, open_lists
from inkwell.sinks.tables import append_results, file_inventory
from inkwell.sources import files
from inkwell.sources.responses import read_results


class Stopped(Exception):
    pass


def rows(spark, lo, hi):
    shard = (F.col("id") % 3).cast("int")
    null = [F.lit(None).cast(t).alias(n) for n, t in (("error_class", "string"), ("error_text", "string"), ("http_status", "int"))]
    return spark.range(lo, hi).select(
        F.col("id").cast("string").alias("id"), F.lit("r").alias("run_id"), F.lit(0).alias("wave"), F.lit("ok").alias("status"), *null,
        F.timestamp_seconds("id").alias("started_at"), F.timestamp_seconds("id").alias("finished_at"),
        F.lit(None).cast(response_ddl("completion")).alias("response"), shard.alias("shard"),
    )


def filled(spark, out):
    for i in range(4):
        append_results(rows(spark, 10 * i, 10 * i + 10).coalesce(1), out)
    return out


def ids(spark, out):
    return sorted(int(r.id) for r in read_results(spark, out, "completion").collect())


STEPS = ["write", "commit-before", "commit-after", "moves-half", "moves", "deletes-half", "deletes", "list"]


def stop_at(step, monkeypatch):
    """The step of `compaction` at which everything ends."""
    write, commit, apply, delete = compaction._write_merged, compaction._commit, compaction._apply, files.delete_folder
    calls = {"apply": 0}

    def writing(*args):
        write(*args)
        raise Stopped

    def committing(*args):
        if step == "commit-after":
            commit(*args)
        raise Stopped

    def applying(spark, path, actions):
        calls["apply"] += 1
        wanted = 1 if step.startswith("moves") else 2
        if calls["apply"] == wanted and step.endswith("half"):
            apply(spark, path, actions.limit(2))
            raise Stopped
        apply(spark, path, actions)
        if calls["apply"] == wanted and step in ("moves", "deletes"):
            raise Stopped

    def deleting(spark, path):
        delete(spark, path)
        if "_compactions" in path:
            raise Stopped

    if step == "write":
        monkeypatch.setattr(compaction, "_write_merged", writing)
    elif step.startswith("commit"):
        monkeypatch.setattr(compaction, "_commit", committing)
    elif step == "list":
        monkeypatch.setattr(files, "delete_folder", deleting)
    else:
        monkeypatch.setattr(compaction, "_apply", applying)


@pytest.mark.parametrize("step", STEPS)
@pytest.mark.parametrize("by_driver", [False, True])
def test_a_stop_leaves_the_same_rows(spark, out, step, by_driver):
    if by_driver and step not in ("moves-half", "deletes-half"):
        pytest.skip("the driver's way differs in moves and deletes only")
    filled(spark, out)
    with pytest.MonkeyPatch.context() as patch:
        if by_driver:
            patch.setattr(compaction, "direct", lambda *_: None)
        with pytest.MonkeyPatch.context() as stop:
            stop_at(step, stop)
            with pytest.raises(Stopped):
                compact(spark, out, max_files=2)
        assert ids(spark, out) == list(range(40))  # a reader finishes what had happened
        assert open_lists(spark, out) == []
        happened = step not in ("write", "commit-before")
        assert file_inventory(spark, out).count() == (3 if happened else 12)
        append_results(rows(spark, 40, 50).coalesce(1), out)
        compact(spark, out, max_files=1)
    assert ids(spark, out) == list(range(50)) and file_inventory(spark, out).count() == 3
    assert not [n for n in os.listdir(out) if n.startswith("_compacting")]


def test_shards_are_merged_in_groups(spark, out, monkeypatch):
    monkeypatch.setattr(compaction, "GROUP", 2)
    filled(spark, out)
    done = compact(spark, out, max_files=2)
    assert (done.shards, done.files_before, done.files_after, done.num_rows) == ((0, 1, 2), 12, 3, 40)
    assert ids(spark, out) == list(range(40))


def test_names_with_encoded_characters(spark, tmp_path):
    out = str(tmp_path / "a b+c%20d")
    filled(spark, out)
    compact(spark, out, max_files=2)
    assert ids(spark, out) == list(range(40)) and file_inventory(spark, out).count() == 3
