"""Runs registered queries against their SQL in DuckDB and compares the rows."""

from __future__ import annotations

import datetime
import math
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf):
    """(verdict, detail, seconds of Spark)."""
    start = time.time()
    df = fn(spark, sf)
    got_rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return "rows only", f"{len(got_rows)} rows", took
    want = con.execute(sql)
    columns = [d[0] for d in want.description]
    if sorted(columns) != sorted(df.columns):
        return "COLUMNS", f"{sorted(df.columns)} != {sorted(columns)}", took
    expected = rows_of(columns, want.fetchall())
    got = rows_of(df.columns, got_rows)
    if got == expected:
        return "ok", f"{sum(got.values())} rows", took
    extra, lacking = list((got - expected).items())[:3], list((expected - got).items())[:3]
    return "DIFF", f"{sum(got.values())} vs {sum(expected.values())}; extra {extra}; lacking {lacking}", took
