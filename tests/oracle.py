"""Rows of a query and of its SQL in DuckDB, in one comparable form."""

from __future__ import annotations

import decimal
import os

import duckdb


def form(v) -> str:
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, decimal.Decimal):
        return f"D{v.normalize()}"
    if isinstance(v, list | tuple):
        return "[" + ",".join(form(x) for x in v) + "]"
    return str(v)


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in os.listdir(folder):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{folder}/{file}'")
    return con


def rows_of(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted(tuple(form(r[c]) for c in names) for r in df.collect())


def rows_of_sql(con, sql: str) -> tuple[list[str], list[tuple]]:
    found = con.sql(sql)
    names = sorted(found.columns)
    at = [found.columns.index(c) for c in names]
    return names, sorted(tuple(form(r[i]) for i in at) for r in found.fetchall())
