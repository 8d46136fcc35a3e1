"""Runs a registered query on Spark and its SQL on DuckDB, and compares the rows."""

from __future__ import annotations

import math

import duckdb

from mediacat.plans.views import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return int(v) if v.is_integer() and abs(v) < 2**53 else float(f"{v:.10g}")
    if hasattr(v, "as_integer_ratio") and not isinstance(v, (int, float)):
        return _plain(float(v))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: [(x is not None, str(type(x)), str(x)) for x in r])


def compare(spark, con, build, sql: str, sf_dir: str) -> tuple[bool, str]:
    df = build(spark, sf_dir)
    names, mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    expected_names, theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    if names != expected_names:
        return False, f"columns {names} != {expected_names}"
    if mine == theirs:
        return True, f"{len(mine)} rows"
    a, b = set(mine), set(theirs)
    return False, f"{len(mine)} rows, expected {len(theirs)}; only here {list(a - b)[:3]}; only there {list(b - a)[:3]}"
