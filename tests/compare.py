"""Rows of a DataFrame and of DuckDB, made comparable."""

import glob
import os

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"


def connection(data: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def _plain(v):
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)) and getattr(v, "ndim", 0):
        return str(v.tolist())
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return "null"
    return str(v) if isinstance(v, (str, bool)) or type(v).__name__ == "bool" else f"{float(v):.9g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple(_plain(v) for v in r) for r in df.itertuples(index=False))
