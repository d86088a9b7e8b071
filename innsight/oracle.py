"""Compare a Spark result with a DuckDB query over the same Parquet tables.

Used by the tests and while developing; mirrors the driver's check (row count,
column names, order-insensitive values).
"""

from __future__ import annotations

import math

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def duckdb_frame(sf_dir: str, sql: str):
    """Run ``sql`` in DuckDB with every test table registered as a view."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con.execute(sql).fetchdf()


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (0, "")
        return (1, round(v, 6) + 0.0)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return (2, tuple(_norm(x) for x in v))
    if hasattr(v, "isoformat"):
        return (3, str(v)[:19])
    return (4, str(v))


def rows_of(pdf) -> list[tuple]:
    cols = sorted(pdf.columns)
    out = [tuple(_norm(r[c]) for c in cols) for r in pdf[cols].to_dict("records")]
    return sorted(out)


def compare(spark_df, sf_dir: str, sql: str) -> tuple[bool, str]:
    """(match, message) for a Spark DataFrame against DuckDB SQL."""
    left = spark_df.toPandas()
    right = duckdb_frame(sf_dir, sql)
    if sorted(left.columns) != sorted(right.columns):
        return False, f"columns differ: {sorted(left.columns)} vs {sorted(right.columns)}"
    if len(left) != len(right):
        return False, f"row counts differ: spark {len(left)} vs duckdb {len(right)}"
    a, b = rows_of(left), rows_of(right)
    if a != b:
        diff = next(i for i, (x, y) in enumerate(zip(a, b)) if x != y)
        return False, f"values differ at sorted row {diff}: {a[diff]} vs {b[diff]}"
    return True, f"{len(a)} rows equal"
