"""Opening files of a shared store inside Python tasks.

Paths are resolved by Hadoop's file system on the driver, so that a mount (`viewfs://`) becomes the store
behind it. What Arrow's own file systems then open is read and written in place, at any offset.
"""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import SparkSession

from inkwell.sources.files import _fs, _path, exists

# Stores whose credentials and addresses Arrow takes from the same place as Hadoop does.
DIRECT = ("file", "hdfs")


def resolved(spark: SparkSession, path: str) -> str:
    """The path in the store that holds it; a path that is not there yet is resolved by its nearest parent."""
    asked = _path(spark, path)
    filesystem = _fs(spark, path)
    missing = []
    while not filesystem.exists(asked) and asked.getParent() is not None:
        missing.insert(0, asked.getName())
        asked = asked.getParent()
    return "/".join([filesystem.resolvePath(asked).toString().rstrip("/"), *missing])


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a resolved path, and the path in it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def direct(spark: SparkSession, path: str) -> str | None:
    """The resolved path if Arrow reaches it, else None."""
    uri = resolved(spark, path)
    if uri.split(":", 1)[0] not in DIRECT and not uri.startswith("/"):
        return None
    try:
        store, inner = open_store(uri)
        store.get_file_info(inner if exists(spark, path) else inner.rsplit("/", 1)[0])
    except (OSError, ValueError, ImportError):  # no Hadoop library beside Arrow
        return None
    return uri
