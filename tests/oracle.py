"""Comparison of a query with its SQL in DuckDB, without regard to the rows' order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    return f"{float(v):.9g}" if isinstance(v, (int, float)) else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def assert_same(df, con, sql):
    found = rows_of(df.columns, [tuple(r) for r in df.collect()])
    out = con.sql(sql)
    assert sorted(df.columns) == sorted(out.columns)
    assert found == rows_of(out.columns, out.fetchall())
