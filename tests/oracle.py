"""Spark result and DuckDB result of a query, brought to one form."""

from pathlib import Path

import duckdb
import pandas as pd


def oracle(sf_dir, sql):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con.sql(sql).df()


def plain(x):
    if x is None or (isinstance(x, float) and x != x) or x is pd.NA or x is pd.NaT:
        return None
    if isinstance(x, float) and x == int(x):
        return int(x)
    if hasattr(x, "item"):
        return plain(x.item())
    return round(x, 6) if isinstance(x, float) else x


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=repr)
