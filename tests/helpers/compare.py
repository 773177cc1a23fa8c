"""Results of a query beside those of its SQL."""

from __future__ import annotations

import glob
import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def connect(folder: str = SMALL):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def text(value) -> str:
    if isinstance(value, float):
        return "nan" if value != value else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(text, value)) + "]"
    return str(value)


def rows_of(df) -> list[str]:
    names = sorted(df.columns)
    return sorted("|".join(map(text, r)) for r in df.select(*names).collect())


def rows_of_sql(con, sql: str, columns: list[str]) -> list[str]:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(columns)
    order = [names.index(c) for c in sorted(columns)]
    return sorted("|".join(text(r[i]) for i in order) for r in result.fetchall())
