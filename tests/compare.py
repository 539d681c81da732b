"""Results of a query and of its SQL in DuckDB, as sorted rows of plain values."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for name in TABLES:
        if (path := Path(sf_dir, f"{name}.parquet")).exists():
            c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return c


def plain(v):
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, bool) or v is None or isinstance(v, (str, datetime.datetime)):
        return v
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    v = float(v)
    return None if math.isnan(v) else round(v, 6)


def rows(names: list[str], values) -> list:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(([plain(r[i]) for i in order] for r in values), key=str)


def same(spark_rows, query_columns: list[str], connection, sql: str) -> None:
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(query_columns)
    assert rows(query_columns, spark_rows) == rows(names, result.fetchall())
