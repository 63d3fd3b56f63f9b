"""Compares a query with its SQL: rows, columns and values, in any order."""

from __future__ import annotations

import decimal
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return db


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def difference(frame, sql: str, db: duckdb.DuckDBPyConnection) -> str:
    """Empty where both agree."""
    got = frame.collect()
    found = db.execute(sql)
    names = [c[0] for c in found.description]
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} and {sorted(names)}"
    a, b = rows(frame.columns, got), rows(names, found.fetchall())
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    for x, y in zip(a, b, strict=True):
        if x != y and not all(p == q or isinstance(p, (int, float)) and isinstance(q, (int, float)) and abs(p - q) < 2e-6 for p, q in zip(x, y, strict=True)):
            return f"{x} and {y}"
    return ""
