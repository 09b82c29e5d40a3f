"""Run a query and its SQL over the same tables and compare rows."""

from __future__ import annotations

import glob
import math
import os
from datetime import date, datetime

import duckdb

TESTDATA = os.environ.get("LOOM_TESTDATA", "/root/testdata")


def connect(sf_dir: str):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (datetime, date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = connect(sf_dir).execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    assert sorted(df.columns) == sorted(cols), (name, df.columns, cols)
    assert len(got) == len(want), (name, len(got), len(want), [x for x in got if x not in set(want)][:3], [x for x in want if x not in set(got)][:3])
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    assert not bad, (name, bad[:3])
    return len(got)
