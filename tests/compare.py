"""Compare registered queries with their SQL on one folder of tables."""

from __future__ import annotations

import hashlib
import math
import time
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def cell(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def digest(columns: list[str], rows: list[tuple]) -> str:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("\x1f".join(cell(row[i]) for i in order) for row in rows)
    return hashlib.md5("\n".join(lines).encode()).hexdigest()


def spark_result(spark, query, folder: str):
    df = query(spark, folder)
    kinds = dict(df.dtypes)
    return df.columns, [tuple(row) for row in df.collect()], kinds


def oracle_result(con, sql: str):
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    return columns, result.fetchall(), {c[0]: str(c[1]) for c in result.description}


def compare(spark, con, name: str, query, sql: str | None, folder: str) -> str:
    """An empty string if both agree, else what differs."""
    started = time.time()
    columns, rows, kinds = spark_result(spark, query, folder)
    took = time.time() - started
    if sql is None:
        return "" if rows else "no rows"
    started = time.time()
    other, expected, other_kinds = oracle_result(con, sql)
    print(f"{name}: {len(rows)} rows, spark {took:.1f}s, sql {time.time() - started:.1f}s", flush=True)
    if sorted(columns) != sorted(other):
        return f"columns {columns} != {other}"
    if len(rows) != len(expected):
        return f"{len(rows)} rows != {len(expected)}"
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = [c for c in columns if same.get(kinds[c]) != other_kinds[c]]
    if odd:
        return f"types differ: {[(c, kinds[c], other_kinds[c]) for c in odd]}"
    if digest(columns, rows) != digest(other, expected):
        a = sorted(tuple(r[columns.index(c)] for c in sorted(columns)) for r in rows)
        b = sorted(tuple(r[other.index(c)] for c in sorted(columns)) for r in expected)
        first = next((x, y) for x, y in zip(a, b) if x != y)
        return f"values differ, first in order: {str(first)[:600]}"
    return ""
