"""Runs a query and its SQL and compares their rows."""

from __future__ import annotations

import glob
import os

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{files}')")
    return con


def _value(x):
    if isinstance(x, float):
        return f"{x:.6g}"
    if isinstance(x, (list, tuple)) or type(x).__name__ == "ndarray":
        return str([_value(y) for y in x])
    return str(x)


def rows(names: list[str], values) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in values)


def compare(spark, sf_dir: str, query, sql: str) -> str:
    """Empty if the rows are equal; else what differs."""
    df = query(spark, sf_dir)
    ours = rows(df.columns, df.collect())
    found = duck(sf_dir).execute(sql)
    names = [c[0] for c in found.description]
    theirs = rows(names, found.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if ours != theirs:
        a, b = set(ours) - set(theirs), set(theirs) - set(ours)
        return f"{len(ours)} and {len(theirs)} rows; only ours {sorted(a)[:3]}, only in SQL {sorted(b)[:3]}"
    return ""
