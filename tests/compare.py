"""Spark against DuckDB on the same tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool):
        return x
    try:
        return round(float(x), 6)
    except (TypeError, ValueError):
        return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def differ(df, sql: str, sf_dir: str) -> str:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(p := f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{p}'")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    want = rows_of(names, got.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(names)} and {sorted(df.columns)}"
    have = rows_of(df.columns, df.collect())
    if have == want:
        return ""
    wanted, had = set(want), set(have)
    a, b = [x for x in have if x not in wanted][:3], [x for x in want if x not in had][:3]
    return f"{len(have)} and {len(want)} rows; only Spark {a}; only SQL {b}"
