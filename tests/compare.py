"""Run registered queries next to their SQL and compare names, kinds and values."""

from __future__ import annotations

import glob
import math
import os
import time

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


TIMES: list[tuple[float, float, int]] = []


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, int):
        return (2, str(v))
    if isinstance(v, float):
        if math.isnan(v):
            return (3, "nan")
        return (3, repr(v + 0.0 if v != 0 else 0.0))
    if isinstance(v, (list, tuple)):
        return (5, str([_norm(x) for x in v]))
    return (4, str(v))


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_norm(row[i]) for i in order) for row in data)


def compare(df, con, sql: str):
    """None when equal, otherwise a short account of the difference."""
    start = time.time()
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    middle = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want_cols, want = rows_of(names, cur.fetchall())
    TIMES.append((round(middle - start, 2), round(time.time() - middle, 2), len(got)))
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; spark {got[:2]} sql {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ {got_cols}: spark {bad[0][0]} sql {bad[0][1]}"
    if not got:
        return "both empty"
    return None
