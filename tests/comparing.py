"""Comparing a query's rows with those of its SQL in DuckDB, in any order."""

import os

import duckdb
import pandas as pd

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    if value is None or (not hasattr(value, "__len__") and pd.isna(value)):
        return "null"
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


def rows(frame: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


def duck(sql: str, sf_dir: str = SF) -> pd.DataFrame:
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"create view {name.split('.')[0]} as select * from '{sf_dir}/{name}'")
    return con.execute(sql).df()
