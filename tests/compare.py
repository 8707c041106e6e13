"""Rows of Spark and DuckDB in one comparable form."""

import datetime
import decimal
import math
import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (int, decimal.Decimal)):
        return f"{float(v):.6g}" if isinstance(v, decimal.Decimal) else str(v) if abs(v) > 10**6 else f"{v:.6g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in sorted(os.listdir(DATA)):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())


def duck_rows(connection, sql):
    found = connection.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(repr([plain(r[i]) for i in order]) for r in found.fetchall())
