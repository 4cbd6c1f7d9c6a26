"""Run a registered query and its SQL counterpart and compare whole results."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    *("region", "nation", "customer", "supplier", "part", "orders", "lineitem"),
    *("documents", "embeddings", "pages", "benchmark", "labels", "conversations"),
)


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _order(row) -> tuple:
    return tuple((v is None, isinstance(v, float), "nan" if v != v else str(v)) for v in row)


def rows_of(columns: list[str], rows) -> list[tuple]:
    """Rows with columns in name order, sorted by their non-numeric values first."""
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(r[i] for i in at) for r in rows]
    return sorted(picked, key=lambda r: (_order([v for v in r if not isinstance(v, float)]), _order(r)))


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return (math.isnan(a) and math.isnan(b)) or a == b
    return type(a) is type(b) and a == b


def differences(spark_df, con, sql: str) -> list[str]:
    """Empty when both results agree in columns, row count and every value."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = rows_of(names, cursor.fetchall())
    actual = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {spark_df.columns} against {names}"]
    if len(actual) != len(expected):
        return [f"{len(actual)} rows against {len(expected)}"]
    wrong = [(a, e) for a, e in zip(actual, expected) if not all(map(same, a, e))]
    return [f"{len(wrong)} rows differ, first {w}" for w in wrong[:1]]
