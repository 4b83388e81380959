"""Listing and moving files through Hadoop's file system API, on any scheme."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from fnmatch import fnmatch
from urllib.parse import unquote

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).exists(_path(spark, path))


def list_files(spark: SparkSession, path: str, pattern: str = "*.parquet") -> list[tuple[str, int]]:
    """(path, bytes) of the files below `path` whose name matches, sorted by path.

    Names starting with `_` or `.` are skipped at every level, as Spark does.
    """
    if not exists(spark, path):
        return []
    root = _fs(spark, path).makeQualified(_path(spark, path)).toString().rstrip("/")
    found = []
    files = _fs(spark, path).listFiles(_path(spark, path), True)
    while files.hasNext():
        status = files.next()
        name = status.getPath().toString()
        parts = name[len(root):].strip("/").split("/") if name != root else []
        if any(part.startswith(("_", ".")) for part in parts):
            continue
        if fnmatch(name.rsplit("/", 1)[-1], pattern):
            found.append((name, status.getLen()))
    return sorted(found)


def has_file(spark: SparkSession, path: str, pattern: str = "*.parquet", recursive: bool = True) -> bool:
    """Whether any visible file below `path` matches; stops at the first one."""
    return first_file(spark, path, pattern, recursive) is not None


def first_file(spark: SparkSession, path: str, pattern: str = "*.parquet", recursive: bool = True) -> str | None:
    """A visible file below `path` that matches, the first one that the file system lists."""
    if not exists(spark, path):
        return None
    fs = _fs(spark, path)
    root = fs.makeQualified(_path(spark, path)).toString().rstrip("/")
    files = fs.listFiles(_path(spark, path), recursive)
    while files.hasNext():
        name = files.next().getPath().toString()
        parts = name[len(root):].strip("/").split("/")
        if not any(part.startswith(("_", ".")) for part in parts) and fnmatch(name.rsplit("/", 1)[-1], pattern):
            return name
    return None


def list_folders(spark: SparkSession, path: str, prefix: str | None = None) -> list[str]:
    """Names of the folders directly below `path`: those that are not hidden, or those that begin with `prefix`."""
    if not exists(spark, path):
        return []
    names = []
    for status in _fs(spark, path).listStatus(_path(spark, path)):
        name = status.getPath().getName()
        wanted = name.startswith(prefix) if prefix else not name.startswith(("_", "."))
        if status.isDirectory() and wanted:
            names.append(name)
    return sorted(names)


def make_folder(spark: SparkSession, path: str) -> None:
    _fs(spark, path).mkdirs(_path(spark, path))


def rename(spark: SparkSession, source: str, target: str) -> None:
    """One rename within a store; an existing target is an error."""
    if exists(spark, target) or not _fs(spark, target).rename(_path(spark, source), _path(spark, target)):
        raise OSError(f"could not rename {source} to {target}")


def move_into(spark: SparkSession, source: str, folder: str) -> None:
    fs = _fs(spark, folder)
    fs.mkdirs(_path(spark, folder))
    target = f"{folder.rstrip('/')}/{source.rsplit('/', 1)[-1]}"
    if not fs.rename(_path(spark, source), _path(spark, target)):
        raise OSError(f"could not move {source} to {target}")


def for_each(action, items: list) -> None:
    """Apply a file action to many items, some at a time; the first error is raised."""
    with ThreadPoolExecutor(max_workers=16) as pool:
        for _ in pool.map(action, items):
            pass


def plain_path(uri: str) -> str:
    """A path as the file system names it, from the encoded form that Spark's file columns have."""
    return unquote(uri)


def delete_file(spark: SparkSession, path: str) -> None:
    if not _fs(spark, path).delete(_path(spark, path), False):
        raise OSError(f"could not delete {path}")


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder this library made, with all it holds."""
    _fs(spark, path).delete(_path(spark, path), True)
