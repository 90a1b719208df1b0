"""Runs a query and its SQL over the same tables and compares the rows as multisets."""
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return bytes(v) if isinstance(v, bytearray) else v


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)


def sql_rows(sql, d):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{d}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    at = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in at], sorted((tuple(_norm(r[i]) for i in at) for r in cur.fetchall()), key=repr)


def assert_same(df, sql, d):
    (a, x), (b, y) = spark_rows(df), sql_rows(sql, d)
    assert a == b
    assert len(x) == len(y)
    assert x == y
