"""Compares registered queries with their SQL in DuckDB."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple((type(_cell(row[i])).__name__, _cell(row[i])) for i in order) for row in rows)


def difference(frame, connection, sql: str) -> str | None:
    """None when columns, Python types and rows are the same, else what differs."""
    result = connection.execute(sql)
    columns = [item[0] for item in result.description]
    expected = _rows(columns, result.fetchall())
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} instead of {sorted(columns)}"
    actual = _rows(frame.columns, [tuple(row) for row in frame.collect()])
    if actual == expected:
        return None
    missing, extra = expected - actual, actual - expected
    return (
        f"{sum(actual.values())} rows, expected {sum(expected.values())}; "
        f"missing {list(missing)[:2]}; extra {list(extra)[:2]}"
    )
