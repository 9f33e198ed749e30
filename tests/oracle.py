"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

from __future__ import annotations

import math
import os

import duckdb


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    return con


def rows_of(spark, query, folder: str) -> tuple[list[str], list[tuple]]:
    df = query(spark, folder)
    columns = sorted(df.columns)
    return columns, sorted((tuple(value(r[c]) for c in columns) for r in df.collect()), key=str)


def oracle_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(value(r[i]) for i in order) for r in cursor.fetchall()), key=str)
