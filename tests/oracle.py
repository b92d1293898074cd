"""Comparison of a query's rows with its SQL in DuckDB: names, counts, values."""

from __future__ import annotations

import glob
import os

import duckdb


def norm(v):
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple((k, norm(x)) for k, x in sorted(v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, float):
        return int(v) if v == int(v) and abs(v) < 1e15 else float(f"{v:.9g}")
    return bytes(v) if isinstance(v, bytearray) else v


def compare(df, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f if os.path.isfile(f) else f + '/*.parquet'}'")
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    mine = sorted(repr([norm(r[c]) for c in cols]) for r in df.collect())
    at = [rel.columns.index(c) for c in cols]
    theirs = sorted(repr([norm(r[i]) for i in at]) for r in rel.fetchall())
    assert len(mine) == len(theirs)
    assert mine == theirs
