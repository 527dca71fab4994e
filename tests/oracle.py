"""Holds a query's rows against its SQL."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def compare(spark, d, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{d}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    df, r = query(spark, d), con.sql(sql)
    cols, theirs = sorted(df.columns), [x[0] for x in r.description]
    assert cols == sorted(theirs)
    mine = sorted((tuple(row[c] for c in cols) for row in df.collect()), key=repr)
    assert mine == sorted((tuple(row[theirs.index(c)] for c in cols) for row in r.fetchall()), key=repr)
