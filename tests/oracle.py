"""Runs registered queries in Spark and their SQL in DuckDB, and compares the rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def plain(x):
    if isinstance(x, float) and math.isnan(x):
        return "nan"
    return x


def compare(df, sql: str, sf_dir: str) -> None:
    names = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    rel = duck(sf_dir).execute(sql)
    found = [d[0] for d in rel.description]
    assert sorted(found) == names, (found, names)
    at = [found.index(c) for c in names]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert len(ours) == len(theirs), (len(ours), len(theirs))
    for a, b in zip(ours, theirs, strict=True):
        assert a == b, (names, a, b)
