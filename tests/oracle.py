"""Run a registered query in Spark and its SQL in DuckDB and compare all rows."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((value is not None, str(type(value).__name__), value) for value in row)


def _norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> tuple[int, str | None]:
    """Row count and the first difference, or None when rows, names and types agree."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return 0, f"columns {sorted(df.columns)} != {sorted(names)}"
    order = sorted(df.columns)
    picks = [names.index(n) for n in order]
    want = sorted((tuple(_norm(r[i]) for i in picks) for r in expected), key=_key)
    got = sorted((tuple(_norm(v) for v in r) for r in df.select(*order).collect()), key=_key)
    if len(got) != len(want):
        return len(got), f"rows {len(got)} != {len(want)}"
    for a, b in zip(got, want):
        if a != b or any(type(x) is not type(y) for x, y in zip(a, b)):
            return len(got), f"spark {a} != oracle {b} ({order})"
    return len(got), None
