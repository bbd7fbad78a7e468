"""Compare a Spark result with a DuckDB result, row for row."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if os.path.isdir(path):
            path += "/*.parquet"
        elif not os.path.exists(path):
            continue
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return (0, "")
    if isinstance(value, bool):
        return (1, value)
    return (2, type(value).__name__, repr(value))


def _table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted([tuple(_cell(r[i]) for i in order) for r in rows])


def differences(df, con, text):
    """None if both agree, otherwise a short description."""
    rows = [tuple(r) for r in df.collect()]
    cursor = con.execute(text)
    names = [d[0] for d in cursor.description]
    ours, mine = _table(df.columns, rows)
    theirs, other = _table(names, cursor.fetchall())
    if ours != theirs:
        return f"columns {ours} and {theirs}"
    if len(mine) != len(other):
        return f"{len(mine)} and {len(other)} rows"
    wrong = [(a, b) for a, b in zip(mine, other) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(mine)} rows differ, first {wrong[0][0]} and {wrong[0][1]} of {ours}"
    return None
