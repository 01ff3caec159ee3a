"""Runs a query and its SQL over the same tables and compares the rows."""

import os

import duckdb
import pandas as pd


def connect(folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    return con


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    text = lambda v: "~" if pd.isna(v) else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(text, row)) for row in frame.itertuples(index=False))


def same(spark, folder, query, sql, con):
    got, want = query(spark, folder).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
    return len(got)
