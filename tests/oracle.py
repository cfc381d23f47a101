"""Runs queries against their SQL, as the driver does."""

from __future__ import annotations

from pathlib import Path

import duckdb

DATA = Path("/root/testdata")


def duck(d: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in sorted(Path(d).glob("*.parquet")):
        c.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


def canon(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return "~" if v != v else f"{v:.4f}"
    if isinstance(v, list | tuple):
        return [canon(x) for x in v]
    if hasattr(v, "tolist"):
        return canon(v.tolist())
    return str(v)


def rows(columns, data) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([canon(r[i]) for i in order]) for r in data)


def compare(spark, name: str, query, sql: str, d: str) -> str:
    """Empty if equal, else what differs."""
    df = query(spark, d)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = duck(d).sql(sql)
    want = rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"{name}: columns {sorted(df.columns)} and {sorted(rel.columns)}"
    if got != want:
        a, b = [x for x in got if x not in set(want)][:3], [x for x in want if x not in set(got)][:3]
        return f"{name}: {len(got)} and {len(want)} rows; only here {a}; only there {b}"
    return ""
