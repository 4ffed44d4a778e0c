"""Runs a query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import glob
import os

import duckdb


def tables(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return round(v, 9)
    return v if isinstance(v, (int, str)) else str(v)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(
        (tuple(_norm(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect()),
        key=repr,
    )


def sql_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(_norm(r[i]) for i in order) for r in cur.fetchall()]
    return sorted(names), sorted(rows, key=repr)
