"""Compares a DataFrame with DuckDB's answer to the same question."""

import math
import os

import duckdb


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v if isinstance(v, (int, bool, type(None))) else str(v)


def differs(df, sql, folder):
    """Empty if rows and columns are the same, in any order."""
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f[:-8]} as select * from '{folder}/{f}'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    at = [names.index(c) for c in df.columns]
    want = sorted((tuple(_plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(map(_plain, r)) for r in df.collect()), key=repr)
    return "" if got == want else f"{len(got)} and {len(want)} rows; {[(a, b) for a, b in zip(got, want) if a != b][:2]}"
