"""Compares a query with its SQL on DuckDB, as multisets of rows with columns by name."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool | int | str):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10] if str(v).endswith("00:00:00") or not hasattr(v, "hour") else v.isoformat()
    return round(float(v), 6) + 0.0


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in found)


def check(spark, sf, query, sql):
    df = query(spark, sf)
    got = df.collect()
    con = connect(sf)
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    want = rel.fetchall()
    assert rows(df.columns, got) == rows(rel.columns, want)
    return got
