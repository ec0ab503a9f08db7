"""Runs a query on Spark and its statement on DuckDB and compares the two results."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.10g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, connection, sf_dir, query, sql):
    """Differences between the two results; an empty list means they are equal."""
    frame = query(spark, sf_dir)
    rows = [tuple(r) for r in frame.collect()]
    cursor = connection.execute(sql)
    columns = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    problems = []
    if sorted(frame.columns) != sorted(columns):
        problems.append(f"columns {sorted(frame.columns)} != {sorted(columns)}")
        return problems, len(rows)
    got, want = digest(frame.columns, rows), digest(columns, expected)
    if got != want:
        extra, missing = list((got - want).items())[:3], list((want - got).items())[:3]
        problems.append(f"{len(rows)} rows against {len(expected)}; only here {extra}; only there {missing}")
    return problems, len(rows)
