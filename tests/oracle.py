"""Runs a query's SQL in DuckDB over the same files and compares rows without regard to order."""

import os

import duckdb


def _plain(v):
    if isinstance(v, float):
        return repr(v)
    return [_plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def compare(df, sql: str, sf: str) -> None:
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    r = c.execute(sql)
    names, want = [x[0] for x in r.description], r.fetchall()
    cols = sorted(df.columns)
    assert cols == sorted(names)
    got = sorted(repr([_plain(row[k]) for k in cols]) for row in df.collect())
    assert got == sorted(repr([_plain(row[names.index(k)]) for k in cols]) for row in want)
