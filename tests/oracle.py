"""Compares a query with its SQL twin, which DuckDB runs on the same Parquet files."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if hasattr(v, "asDict"):
        return tuple(map(plain, v.asDict().values()))
    if isinstance(v, dict):
        return tuple(map(plain, v.values()))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def twin_rows(sf_dir: str, sql: str):
    db = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if Path(path).exists():
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    result = db.execute(sql)
    columns = [d[0] for d in result.description]
    return sorted(columns), rows_of(columns, result.fetchall())


def compare(df, sf_dir: str, sql: str) -> str | None:
    """What differs, or None."""
    columns, want = twin_rows(sf_dir, sql)
    if sorted(df.columns) != columns:
        return f"columns {sorted(df.columns)} and {columns}"
    got = rows_of(df.columns, df.collect())
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"{a} and {b}"
    return None
