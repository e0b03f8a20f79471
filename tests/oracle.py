"""Run queries and their SQL on the same tables and compare all rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def differences(df, con, sql: str) -> list[str]:
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    if sorted(columns) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} and {sorted(columns)}"]
    order = sorted(columns)
    want = sorted(tuple(_cell(r[columns.index(c)]) for c in order) for r in found.fetchall())
    have = sorted(tuple(_cell(r[c]) for c in order) for r in df.collect())
    if len(want) != len(have):
        return [f"{len(have)} rows, SQL has {len(want)}"]
    return [f"{h} and {w}" for h, w in zip(have, want, strict=True) if h != w][:3]
