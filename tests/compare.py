"""Rows of a query against those of its SQL in DuckDB."""

import glob
import os
from collections import Counter

import duckdb


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return round(value, 6)
    return int(value) if isinstance(value, int) else value


def sql_rows(sf_dir, sql):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    found = con.execute(sql)
    return [d[0] for d in found.description], found.fetchall()


def assert_same(df, sf_dir, sql):
    names, rows = sql_rows(sf_dir, sql)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    want = Counter(tuple(plain(row[names.index(c)]) for c in order) for row in rows)
    got = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
    return sum(got.values())
