"""Comparison of a query with its SQL, by value and regardless of order."""

import datetime
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def connect(folder=DATA):
    con = duckdb.connect(config={"threads": 2})
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{f}')")
    return con


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


def result(df):
    names = sorted(df.columns)
    return names, sorted((tuple(map(plain, r)) for r in df.select(*names).collect()), key=repr)


def expected(con, sql):
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in got.fetchall()), key=repr)
