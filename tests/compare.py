"""Compare a Spark result with the rows DuckDB returns for its twin."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


def differences(spark_df, con, sql: str) -> list[str]:
    """Empty if both sides have the same columns, value types and rows."""
    left = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    right = rows_of(names, cursor.fetchall())
    found = []
    if sorted(spark_df.columns) != sorted(names):
        found.append(f"columns {sorted(spark_df.columns)} / {sorted(names)}")
    if len(left) != len(right):
        found.append(f"rows {len(left)} / {len(right)}")
    for a, b in zip(left, right):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            found.append(f"{a} / {b}")
            if len(found) > 4:
                break
    return found
