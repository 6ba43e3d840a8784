"""Compares a Spark result with DuckDB's on the same files."""

from __future__ import annotations

import datetime
import math
import os

import duckdb

TESTDATA = os.environ.get("TESTDATA", "/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in sorted(os.listdir(sf_dir)):
        path = f"{sf_dir}/{name}/*.parquet" if os.path.isdir(f"{sf_dir}/{name}") else f"{sf_dir}/{name}"
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(_plain(v) for _, v in sorted(value.items()))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(frame, sql: str, sf_dir: str) -> None:
    con = connect(sf_dir)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns), (names, frame.columns)
    expected, got = rows_of(names, result.fetchall()), rows_of(frame.columns, frame.collect())
    assert len(got) == len(expected), f"{len(got)} rows, expected {len(expected)}"
    differing = [(g, e) for g, e in zip(got, expected) if g != e]
    assert not differing, f"{len(differing)} rows differ, first {differing[0]}"
