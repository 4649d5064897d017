"""Holds a query's rows against those of its SQL."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb


def plain(value):
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def connection(folder: str):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for name in os.listdir(folder):
        path = os.path.join(folder, name)
        c.execute(f"create view {name.split('.')[0]} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def check(spark, folder, query, sql) -> int:
    df = query(spark, folder)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[k]) for k in columns) for r in df.collect()), key=repr)
    found = connection(folder).execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    at = [names.index(k) for k in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    return len(got)
