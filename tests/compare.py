"""Run a query in Spark and its SQL in DuckDB and compare whole results."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT", "date": "DATE",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(glob.glob(os.path.join(folder, "*.parquet"))):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, float):
        return repr(value)
    return str(value)


def spark_rows(df) -> tuple[list[str], list[str], list[tuple]]:
    order = sorted(df.columns)
    df = df.select(*order)
    kinds = [TYPES.get(t, t) for _, t in df.dtypes]
    return order, kinds, sorted(tuple(_cell(v) for v in row) for row in df.collect())


def duck_rows(con, sql: str) -> tuple[list[str], list[str], list[tuple]]:
    rel = con.sql(sql)
    names, kinds = list(rel.columns), [str(t) for t in rel.types]
    place = sorted(range(len(names)), key=lambda i: names[i])
    rows = sorted(tuple(_cell(row[i]) for i in place) for row in rel.fetchall())
    return [names[i] for i in place], [kinds[i] for i in place], rows


def difference(df, con, sql: str) -> str | None:
    """None when equal, otherwise a short description."""
    a_names, a_kinds, a = spark_rows(df)
    b_names, b_kinds, b = duck_rows(con, sql)
    if a_names != b_names:
        return f"columns {a_names} != {b_names}"
    if a_kinds != b_kinds:
        return f"types {list(zip(a_names, a_kinds))} != {b_kinds}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, first {a_names} {bad[0]}" if bad else None
