"""Rows of a registered query and of its SQL, made comparable."""

import os

import duckdb

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return repr(v)


def connection():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{DATA}/{f}')")
    return c


def both(spark, connection, query, sql):
    df = query(spark, DATA)
    columns = sorted(df.columns)
    own = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    rel = connection.sql(sql)
    names = rel.columns
    assert sorted(names) == columns
    other = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall())
    return own, other
