import os

import pytest

from inkwell.config import ConfigError, RunConfig, api_key, config_from_dict, load_config

GOOD = {
    "api_type": "chat-completion",
    "api_base_url": "http://a:1/v1, http://b:1/v1/",
    "model": "m",
    "dataset_type": "parquet",
    "dataset_path": "/data/in",
    "output_path": "out",
    "max_connections": 50,
    "partition": "ignored",
}


def test_defaults_and_absolute_output():
    config = config_from_dict({**GOOD, "completions_kwargs": None})
    assert config.completions_kwargs == {} and config.dataset_kwargs == {}
    assert config.output_path == os.path.abspath("out")
    assert (config.max_retries, config.num_workers, config.max_consecutive_failures) == (3, 4, 20)
    assert (config.input_column_name, config.id_column_name) == ("prompt", "id")
    assert config.endpoints == ["http://a:1/v1", "http://b:1/v1"]


def test_remote_output_path_is_kept():
    assert config_from_dict({**GOOD, "output_path": "s3a://bucket/out"}).output_path == "s3a://bucket/out"


@pytest.mark.parametrize(
    "change",
    [
        {"api_type": "speech"},
        {"dataset_type": "excel"},
        {"max_connections": 0},
        {"max_retries": -1},
        {"num_workers": 0},
        {"num_inference_servers": 0},
        {"completions_kwargs": {"x": object()}},
        {"min_success_ratio": 1.5},
    ],
)
def test_bad_values(change):
    with pytest.raises(ConfigError):
        config_from_dict({**GOOD, **change})


def test_missing_fields_are_named():
    with pytest.raises(ConfigError, match="model, dataset_path"):
        config_from_dict({k: v for k, v in GOOD.items() if k not in ("model", "dataset_path")})


def test_connections_are_shared_by_tasks():
    config = config_from_dict({**GOOD, "max_connections": 10, "num_workers": 4})
    assert (config.connections_per_task, config.tasks_per_shard) == (2, 4)
    few = config_from_dict({**GOOD, "max_connections": 2, "num_workers": 4})
    assert (few.connections_per_task, few.tasks_per_shard) == (1, 2)


def test_environment(monkeypatch):
    monkeypatch.setenv("API_BASE_URL", "http://other/v1")
    monkeypatch.setenv("API_KEY", "secret")
    assert config_from_dict(GOOD).endpoints == ["http://other/v1"]
    assert api_key() == "secret"
    monkeypatch.delenv("API_KEY")
    assert api_key() == "EMPTY"


def test_yaml(tmp_path):
    path = tmp_path / "config.yaml"
    path.write_text(
        "api_type: completion\napi_base_url: http://x/v1\nmodel: m\ndataset_type: hf\ndataset_path: /d\n"
        "output_path: /o\nmax_connections: 8\ncompletions_kwargs:\n  extra_body: {min_tokens: 5}\n"
    )
    config = load_config(str(path))
    assert isinstance(config, RunConfig) and config.completions_kwargs == {"extra_body": {"min_tokens": 5}}
    path.write_text("- a\n")
    with pytest.raises(ConfigError):
        load_config(str(path))
