"""Compares a query with its oracle, as sorted rows by column name."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        con.sql(f"create view {name} as select * from read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return con


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(str, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()))


def check(spark, folder, function, sql):
    ours = rows_of(function(spark, folder).toPandas())
    theirs = rows_of(duck(folder).sql(sql).df())
    assert ours == theirs
    return len(ours[1])
