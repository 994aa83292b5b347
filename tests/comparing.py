"""A query's rows against its SQL on DuckDB, floats to 9 digits."""

import glob
import os

import duckdb

DATA = "/root/testdata"


def connect(sf):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for f in glob.glob(f"{DATA}/{sf}/*.parquet"):
        at = f if os.path.isfile(f) else f"{f}/*.parquet"
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{at}'")
    return con


def norm(v):
    if v is None or v is False or v is True:
        return str(v)
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


def table(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in data)


def assert_same(spark, con, fn, sql, sf):
    df = fn(spark, f"{DATA}/{sf}")
    got = table(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    assert got == table([c[0] for c in res.description], res.fetchall())
