"""Compares a query's rows with its SQL's in DuckDB: row count, column names and values without order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def compared(df, sql: str, sf_dir: str):
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = connect(sf_dir).sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    return got, want
