"""Comparing a query with its SQL in DuckDB."""

import math
import os
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (float, Decimal)):
        return "nan" if math.isnan(value) else f"{float(value):.7g}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, name, function, sql, folder):
    df = function(spark, folder)
    got = rows_of(df.columns, df.collect())
    result = connect(folder).execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns), name
    assert got == rows_of(columns, result.fetchall()), name
