"""Run registered queries beside their DuckDB SQL."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def both(spark, query, sql, sf):
    df = query(spark, sf)
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = duck(sf).sql(sql)
    return ours, rows(rel.columns, rel.fetchall())
