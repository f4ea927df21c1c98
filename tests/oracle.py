"""Comparing a query's rows with its oracle's."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    con.execute("SET timezone = 'UTC'")
    return con


def plain(value) -> str:
    if value is None or type(value).__name__ in ("NAType", "NaTType") or value != value:
        return ""
    if isinstance(value, bool) or type(value).__name__ == "bool":
        return str(bool(value))
    if isinstance(value, (int, float)) or type(value).__name__.startswith(("int", "float", "uint")):
        return f"{float(value):.6f}"
    return str(value)


def rows(frame) -> list[tuple[str, ...]]:
    columns = sorted(frame.columns)
    return sorted(tuple(map(plain, r)) for r in frame[columns].itertuples(index=False))


def assert_same(spark_frame, oracle_frame) -> None:
    assert sorted(spark_frame.columns) == sorted(oracle_frame.columns)
    got, expected = rows(spark_frame), rows(oracle_frame)
    assert len(got) == len(expected)
    assert got == expected
