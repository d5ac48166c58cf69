"""Comparing a Spark result with a DuckDB result, row by row and order-free."""

from __future__ import annotations

import math

RAW = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(folder: str):
    import duckdb

    connection = duckdb.connect()
    for name in RAW.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return list(value) if isinstance(value, (list, tuple)) else value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([_plain(row[i]) for i in order] for row in rows), key=repr), [columns[i] for i in order]


def differences(df, connection, sql: str) -> list[str]:
    mine, names = _rows(df.columns, [tuple(r) for r in df.collect()])
    result = connection.execute(sql)
    theirs, other = _rows([c[0] for c in result.description], result.fetchall())
    problems = []
    if names != other:
        problems.append(f"columns {names} and {other}")
    if len(mine) != len(theirs):
        problems.append(f"{len(mine)} and {len(theirs)} rows")
    if not problems:
        different = [(a, b) for a, b in zip(mine, theirs) if a != b or [type(x) for x in a] != [type(x) for x in b]]
        problems += [f"{a} and {b}" for a, b in different[:3]]
        if different:
            problems.append(f"{len(different)} different rows")
    return problems
