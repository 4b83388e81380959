import pytest
from pyspark.sql import functions as F

from inkwell.__main__ import main
from inkwell.operators.client import StubClient
from inkwell.config import load_config
from inkwell.plans.run import run
from inkwell.sources.ledgers import read_ledger


@pytest.fixture
def config_file(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.range(20).select(F.col("id").cast("string").alias("id"), F.lit("hello").alias("prompt")).write.parquet(folder)
    path = tmp_path / "config.yaml"
    path.write_text(
        "api_type: completion\napi_base_url: http://127.0.0.1:9/v1\nmodel: m\ndataset_type: parquet\n"
        f"dataset_path: {folder}\noutput_path: {tmp_path}/out\nmax_connections: 4\nmax_retries: 0\nnum_inference_servers: 2\n"
        "max_consecutive_failures: 3\n"
    )
    return str(path)


def test_checks(config_file, tmp_path, capsys):
    assert main(["validate-config", "--config", config_file]) == 0
    assert main(["validate-data", "--config", config_file, "--shard", "1", "--num-shards", "2"]) == 0
    assert "id_blank" in capsys.readouterr().out
    assert main(["validate-data", "--config", config_file, "--shard", "2", "--num-shards", "2"]) == 2
    broken = tmp_path / "broken.yaml"
    broken.write_text("api_type: completion\n")
    assert main(["validate-config", "--config", str(broken)]) == 2
    assert main(["validate-config", "--config", str(tmp_path / "absent.yaml")]) == 2


def test_status_and_compaction(spark, config_file, capsys):
    run(spark, load_config(config_file), StubClient(), num_waves=3)
    assert main(["status", "--config", config_file, "--detailed", "--recent-minutes", "60"]) == 0
    shown = capsys.readouterr().out
    assert shown.count("complete") >= 2 and "Total requests" in shown and "100.0%" in shown
    assert main(["status", "--config", config_file, "--shards", "7"]) == 2
    assert main(["compact", "--config", config_file, "--max-files", "1"]) == 0
    assert "num_rows=20" in capsys.readouterr().out


def test_status_from_the_log_and_ledger_of_a_run(spark, config_file, tmp_path, capsys):
    log, ledger = str(tmp_path / "log"), str(tmp_path / "ledger")
    config = load_config(config_file)
    run(spark, config, StubClient(), progress_path=log, ledger_path=ledger, shards=[1])
    assert main(["next-shards", "--config", config_file, "--ledger", ledger]) == 0
    assert capsys.readouterr().out.split()[-1] == "0"
    command = ["status", "--config", config_file, "--detailed", "--recent-minutes", "60", "--log", log, "--ledger", ledger]
    assert main(command) == 0
    shown = capsys.readouterr().out
    assert "Total requests" in shown and "|1    |true     |" in shown and "|0    |false    |" in shown
    run(spark, config, StubClient(), progress_path=log, ledger_path=ledger)
    assert main(["next-shards", "--config", config_file, "--ledger", ledger]) == 0
    assert capsys.readouterr().out.split() == []


def test_unreachable_endpoint_fails_the_run(spark, config_file, tmp_path, capsys):
    # Nothing listens there, so every request fails to connect.
    log = str(tmp_path / "log")
    assert main(["run", "--config", config_file, "--log", log, "--ledger", str(tmp_path / "ledger")]) == 1
    assert "endpoint appears to be down" in capsys.readouterr().err
    # which tasks meet three failures in a row, and so which shards are left open, depends on how rows are dealt
    assert read_ledger(spark, str(tmp_path / "ledger" / "failed"), "failed").select("shard").distinct().count() >= 1


def test_transforms_come_from_a_file(spark, config_file, tmp_path, capsys):
    (tmp_path / "mine.py").write_text(
        "from inkwell.operators.transforms import register_rows\n"
        "MARK = '!'\n"
        "@register_rows('shout_rows', 'id string, prompt string')\n"
        "def shout_rows(row, times=1):\n"
        "    return {'prompt': row['prompt'] + MARK * times}\n"
    )
    with open(config_file, "a") as handle:
        handle.write("apply_udf: shout_rows\napply_udf_kwargs: {times: 2}\n")
    assert main(["validate-data", "--config", config_file, "--transforms", str(tmp_path / "mine.py")]) == 0
    assert "hello!!" in capsys.readouterr().out
