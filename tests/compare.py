"""Run queries in Spark and in DuckDB and compare the results as sets of rows."""

from __future__ import annotations

import datetime
import math
from collections import Counter

import duckdb

from workload.harness import ORACLES, QUERIES, TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, int):
        return v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), Counter(tuple(norm(r[i]) for i in order) for r in data)


def check(spark, con, name: str, sf_dir: str):
    """None when both agree, else a short text."""
    df = QUERIES[name](spark, sf_dir)
    got_cols, got = rows(df.columns, df.collect())
    if name not in ORACLES:
        return None if got else "empty"
    cur = con.execute(ORACLES[name])
    want_cols, want = rows([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if got != want:
        return (
            f"rows {sum(got.values())} vs {sum(want.values())}; only spark {list((got - want).items())[:3]}; "
            f"only sql {list((want - got).items())[:3]}"
        )
    if not want:
        return "both empty"
    return None
