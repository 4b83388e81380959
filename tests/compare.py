"""Compare registered queries with their SQL, run by DuckDB on the same files.

    python tests/compare.py [data folder] [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TESTDATA = os.environ.get("INKWELL_TESTDATA", "/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    return value


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(row[i]) for i in order) for row in rows), key=repr)


_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def check(spark, connection, sf_dir: str, fn, sql: str) -> str | None:
    """None if equal, else what differs."""
    frame = fn(spark, sf_dir)
    cursor = connection.execute(sql)
    sql_names = [d[0] for d in cursor.description]
    sql_types = {d[0]: str(d[1]) for d in cursor.description}
    if sorted(frame.columns) != sorted(sql_names):
        return f"columns {sorted(frame.columns)} != {sorted(sql_names)}"
    types = [(n, t, sql_types[n]) for n, t in frame.dtypes if _TYPES.get(t, t) != sql_types[n]]
    if types:
        return f"types {types}"
    got = _rows(frame.columns, frame.collect())
    want = _rows(sql_names, cursor.fetchall())
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(wrong)} of {len(got)} rows differ, first {wrong[0]}" if wrong else None


def main() -> int:
    from inkwell.session import build_session
    from __spark_entry__ import oracle_sql, queries

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else f"{TESTDATA}/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session(master="local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    connection, oracles, bad = connect(sf_dir), oracle_sql(), 0
    for name, fn in queries().items():
        if wanted and name not in wanted:
            continue
        began = time.time()
        try:
            if name in oracles:
                problem = check(spark, connection, sf_dir, fn, oracles[name])
            else:
                problem = None if fn(spark, sf_dir).count() >= 0 else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {time.time() - began:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{bad} failed of {len(wanted) or len(queries())}")
    return bad


if __name__ == "__main__":
    sys.exit(main())
