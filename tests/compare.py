"""Run a query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        number = float(value)
        return 0.0 if number == 0 else (number if math.isfinite(number) else str(number))
    return str(value)


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(_cell(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(cells, key=repr)


def spark_rows(df):
    return _table(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cursor = con.execute(sql)
    return _table([d[0] for d in cursor.description], cursor.fetchall())


def differences(got, want, limit: int = 3) -> list[str]:
    """Readable differences; doubles may differ by one unit of the sixth digit's tenth."""
    if got[0] != want[0]:
        return [f"columns {got[0]} != {want[0]}"]
    if len(got[1]) != len(want[1]):
        return [f"{len(got[1])} rows != {len(want[1])}"]
    out = [f"{a} != {b}" for a, b in zip(got[1], want[1]) if a != b]
    return out[:limit] + ([f"… {len(out)} rows differ"] if out else [])
