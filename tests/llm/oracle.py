"""Compares a registered query with its SQL twin in DuckDB."""

import os

import duckdb

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in NAMES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def assert_same(spark, query, sql, sf_dir):
    frame = query(spark, sf_dir)
    found = connect(sf_dir).sql(sql)
    assert sorted(frame.columns) == sorted(found.columns)
    columns = sorted(frame.columns)
    got = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)
    at = [found.columns.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)
    assert got == want
    return got
