"""Holding a query against its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    found = duckdb.connect()
    for path in Path(sf_dir).iterdir():
        at = path if path.is_file() else path / "*.parquet"
        found.execute(f"CREATE VIEW {path.name.split('.')[0]} AS SELECT * FROM '{at}'")
    return found


def plain(value) -> str | None:
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return repr(round(value, 9)) if isinstance(value, float) else str(value)


def rows(columns: list[str], values) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(v[k]) for k in order) for v in values), key=str)


def agree(df, sql: str, connection) -> None:
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    expected = rows(names, cursor.fetchall())
    got = rows(df.columns, df.collect())
    assert len(got) == len(expected)
    assert got == expected
