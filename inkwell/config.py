"""Run configuration: one validated record, read from YAML or built in code."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields
from typing import Any

API_TYPES = ("completion", "chat-completion")

# Source formats by dataset_type. The first three are the names existing config
# files use; the others are Spark's own format names.
DATASET_FORMATS = {
    "parquet": "parquet",
    "hf": "parquet",
    "hf-disk": "arrow",
    "json": "json",
    "csv": "csv",
    "orc": "orc",
    "text": "text",
}


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class RunConfig:
    api_type: str
    model: str
    dataset_path: str
    output_path: str
    max_connections: int
    api_base_url: str = ""
    dataset_type: str = "parquet"
    input_column_name: str = "prompt"
    id_column_name: str = "id"
    dataset_kwargs: dict[str, Any] = field(default_factory=dict)
    completions_kwargs: dict[str, Any] = field(default_factory=dict)
    apply_udf: str | None = None
    apply_udf_kwargs: dict[str, Any] = field(default_factory=dict)
    max_retries: int = 3
    num_workers: int = 4
    max_consecutive_failures: int = 20
    request_timeout_seconds: float = 300.0
    num_inference_servers: int = 1
    job_name: str = "inkwell"
    min_success_ratio: float = 0.0

    def __post_init__(self) -> None:
        for name in ("dataset_kwargs", "completions_kwargs", "apply_udf_kwargs"):
            if getattr(self, name) is None:
                object.__setattr__(self, name, {})
        if "://" not in self.output_path:
            object.__setattr__(self, "output_path", os.path.abspath(self.output_path))
        problems = []
        if self.api_type not in API_TYPES:
            problems.append(f"api_type {self.api_type!r} is not one of {API_TYPES}")
        if self.dataset_type not in DATASET_FORMATS:
            problems.append(f"dataset_type {self.dataset_type!r} is not one of {tuple(DATASET_FORMATS)}")
        for name, least in (
            ("max_connections", 1),
            ("max_retries", 0),
            ("num_workers", 1),
            ("max_consecutive_failures", 1),
            ("num_inference_servers", 1),
        ):
            value = getattr(self, name)
            if not isinstance(value, int) or isinstance(value, bool) or value < least:
                problems.append(f"{name} must be an integer of at least {least}, got {value!r}")
        if not self.request_timeout_seconds > 0:
            problems.append("request_timeout_seconds must be positive")
        if not 0.0 <= self.min_success_ratio <= 1.0:
            problems.append("min_success_ratio must be between 0 and 1")
        try:
            json.dumps(self.completions_kwargs)
        except TypeError as error:
            problems.append(f"completions_kwargs cannot be sent as JSON: {error}")
        if problems:
            raise ConfigError("; ".join(problems))

    @property
    def num_shards(self) -> int:
        return self.num_inference_servers

    @property
    def connections_per_task(self) -> int:
        """Each shard's requests run in `num_workers` tasks that share its connections."""
        return max(1, self.max_connections // self.num_workers)

    @property
    def tasks_per_shard(self) -> int:
        """Never more tasks than connections, or a shard would exceed its limit."""
        return min(self.num_workers, self.max_connections)

    @property
    def endpoints(self) -> list[str]:
        """Base URLs, comma separated in the config; `API_BASE_URL` overrides it."""
        return split_urls(os.environ.get("API_BASE_URL") or self.api_base_url)


def split_urls(text: str) -> list[str]:
    return [url.strip().rstrip("/") for url in text.split(",") if url.strip()]


def api_key() -> str:
    """The key, read on the driver. It reaches tasks in the client factory only."""
    return os.environ.get("API_KEY", "EMPTY")


def config_from_dict(data: dict[str, Any]) -> RunConfig:
    """Build a config from a mapping; keys this library does not use are ignored."""
    known = {f.name for f in fields(RunConfig)}
    values = {key: value for key, value in data.items() if key in known}
    required = ("api_type", "api_base_url", "model", "dataset_type", "dataset_path", "output_path",
                "max_connections")
    missing = [name for name in required if data.get(name) is None]
    if missing:
        raise ConfigError(f"missing required fields: {', '.join(missing)}")
    for name in ("dataset_path", "output_path"):
        values[name] = str(values[name])
    return RunConfig(**values)


def load_config(path: str) -> RunConfig:
    """Read a YAML (or JSON) config file."""
    import yaml

    with open(path, encoding="utf-8") as handle:
        data = yaml.safe_load(handle)
    if not isinstance(data, dict):
        raise ConfigError(f"{path} does not hold a mapping")
    return config_from_dict(data)
