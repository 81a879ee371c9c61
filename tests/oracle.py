"""Comparison of a Spark result with DuckDB SQL over the same Parquet tables."""

import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 8) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(v) if hasattr(v, "as_tuple") else v


def connect(folder):
    c = duckdb.connect()
    for name in os.listdir(folder):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    return c


def assert_same(df, sql, folder):
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = connect(folder).execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want
