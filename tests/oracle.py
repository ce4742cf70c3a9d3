"""Runs queries beside their SQL twins, as multisets of rows."""

from __future__ import annotations

import datetime
import math
import os
from collections import Counter

import duckdb

from provloom.session import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


def differences(spark, con, name, query, sql, sf_dir) -> str | None:
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    cursor = con.execute(sql)
    found = [d[0] for d in cursor.description]
    if sorted(found) != names:
        return f"{name}: columns {names} and {sorted(found)}"
    want = Counter(tuple(plain(r[found.index(c)]) for c in names) for r in cursor.fetchall())
    if got != want:
        return f"{name}: {sum(got.values())} and {sum(want.values())} rows; only here {list((got - want).items())[:3]}, only there {list((want - got).items())[:3]}"
    return None
