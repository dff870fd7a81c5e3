"""Compare a query with its SQL in DuckDB on the same tables."""

import os

import duckdb
import numpy as np
import pandas as pd


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if v is None or v is pd.NaT or isinstance(v, float) and v != v:
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (float, np.floating)):
        return round(float(v), 9)
    if isinstance(v, (int, np.integer)):
        return int(v)
    return v


def key(row):
    return tuple((v is None, str(v)) for v in row)


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)


def rows_of_sql(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{t}'")
    rel = con.sql(sql)
    cols = sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    return cols, sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=key)
