"""Runs a query's SQL in DuckDB and compares its rows with Spark's, in any order."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

from quillstone.sources.tables import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        path += "/*.parquet" if os.path.isdir(path) else ""
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (float, decimal.Decimal)):
        value = float(value)
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()[:10] if not isinstance(value, datetime.datetime) else value.replace(tzinfo=None).isoformat()
    if isinstance(value, dict):
        return tuple(sorted((str(k), plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def as_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def numeric(rows: list[tuple]) -> list[tuple]:
    return [tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in r) for r in rows]


def compare(spark, con, run, sql: str, sf_dir: str) -> tuple[bool, int, str]:
    df = run(spark, sf_dir)
    mine = as_rows(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    theirs = as_rows(columns, found.fetchall())
    if sorted(df.columns) != sorted(columns):
        return False, len(mine), f"columns {sorted(df.columns)} and {sorted(columns)}"
    mine, theirs = numeric(mine), numeric(theirs)
    if mine == theirs:
        return True, len(mine), ""
    odd = next(((a, b) for a, b in zip(mine, theirs) if a != b), (len(mine), len(theirs)))
    return False, len(mine), f"{len(mine)} and {len(theirs)} rows; first difference {str(odd)[:600]}"
