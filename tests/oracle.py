"""Runs a query and its SQL side by side, as the driver does."""

import decimal
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in sorted(os.listdir(sf_dir)):
        if f.endswith(".parquet"):
            con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else float(v) if isinstance(v, decimal.Decimal) else v


def ordered(names, rows):
    at = [names.index(c) for c in sorted(names)]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


def assert_same(df, con, sql):
    found = con.execute(sql)
    names, rows = [c[0] for c in found.description], found.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert ordered(df.columns, df.collect()) == ordered(names, rows)
