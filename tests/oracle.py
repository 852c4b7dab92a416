"""Compare a query with its SQL on the same tables."""

import decimal
import glob
import math
import os

import duckdb


def connect(path):
    c = duckdb.connect()
    for f in glob.glob(f"{path}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def same(spark, con, query, sql, path):
    df = query(spark, path)
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted((tuple(plain(r[names.index(n)]) for n in order) for r in cur.fetchall()), key=str)
    got = sorted((tuple(plain(r[n]) for n in order) for r in df.collect()), key=str)
    assert got == want
    return len(got)
