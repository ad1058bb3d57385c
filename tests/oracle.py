"""Runs a query and its SQL over the same tables and compares rows."""

import glob
import math
import os

import duckdb


def views(d):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{d}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def key(row):
    return tuple((v is None, str(type(v).__name__), str(v)) for v in row)


def compare(spark, d, query, sql):
    df = query(spark, d)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    r = views(d).execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = [tuple(plain(row[i]) for i in at) for row in r.fetchall()]
    assert sorted(got, key=key) == sorted(want, key=key)
