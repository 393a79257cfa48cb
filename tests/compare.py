"""Run a registered query on Spark and its SQL on DuckDB and compare rows by sorted columns."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def rows_of(names: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=repr)


def compare(df, sql: str, con: duckdb.DuckDBPyConnection) -> str | None:
    """None if they agree, else what differs."""
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    want = rows_of(names, got.fetchall())
    have = rows_of(df.columns, df.collect())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if have != want:
        extra, missing = set(have) - set(want), set(want) - set(have)
        return f"{len(have)} and {len(want)} rows; only Spark {sorted(extra, key=repr)[:3]}; only SQL {sorted(missing, key=repr)[:3]}"
    return None
