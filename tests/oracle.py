"""Runs a query and its SQL side by side."""

from __future__ import annotations

import glob
import os

import duckdb


def tables(d: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in glob.glob(f"{d}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows_of(columns: list[str], rows: list) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, d: str, query, sql: str) -> tuple[int, int, list]:
    df = query(spark, d)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = tables(d).execute(sql)
    names = [c[0] for c in res.description]
    want = rows_of(names, res.fetchall())
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    return len(got), len(want), [x for x in zip(got, want, strict=False) if x[0] != x[1]][:3]
