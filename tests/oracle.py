"""Compares a registered query with its SQL, run by DuckDB on the same tables."""

import glob
import math
import os

import duckdb

DATA = "/root/testdata/sf0.01"


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return str(v) if v is not None and not isinstance(v, (int, bool)) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, query, sql, data=DATA):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.sql(sql)
    df = query(spark, data)
    got = rows_of(df.columns, df.collect())
    want = rows_of(want.columns, want.fetchall())
    assert got[0] == want[0], (got[0], want[0])
    assert len(got[1]) == len(want[1]), (len(got[1]), len(want[1]))
    for a, b in zip(got[1], want[1]):
        assert a == b, (got[0], a, b)
    return len(got[1])
