"""Runs a query and its SQL twin and compares their rows."""

import os

import duckdb


def tables(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


def value(x):
    if isinstance(x, float):
        return repr(round(x, 9) + 0.0)
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(value, x)) + "]"
    return str(int(x)) if isinstance(x, bool) else str(x)


def normal(rows, columns, names):
    at = [columns.index(n) for n in names]
    return sorted(tuple(value(r[i]) for i in at) for r in rows)


def assert_equal(df, con, sql: str) -> None:
    want = con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    columns = want.columns
    got = normal([tuple(r) for r in df.collect()], df.columns, names)
    assert got == normal(want.fetchall(), columns, names)
