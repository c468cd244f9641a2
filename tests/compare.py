"""Spark results against DuckDB's: the same columns, kinds of values and rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set threads to 4")
    for t in TABLES:
        if Path(folder, f"{t}.parquet").exists():
            con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}") + 0.0
    return v


def rows(columns: list[str], found) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    theirs = rows(names, got.fetchall())
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs):
        assert a == b
