"""Spark against DuckDB, as rows in any order."""

import datetime
import os

import duckdb
import numpy as np
import pandas as pd


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if "datetime" in str(df[c].dtype):
            df[c] = df[c].dt.strftime("%Y-%m-%d")
        elif pd.api.types.is_numeric_dtype(df[c]) or pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype(float)
        else:
            dates = (datetime.date, datetime.datetime)
            df[c] = df[c].map(lambda x: None if x is None or x is pd.NaT or isinstance(x, float) and np.isnan(x) else str(x)[:10] if isinstance(x, dates) else str(x))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def oracle(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con.execute(sql).df()


def assert_same(spark_rows: pd.DataFrame, sql: str, sf_dir: str) -> None:
    a, b = normal(spark_rows), normal(oracle(sql, sf_dir))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=0, atol=1.1e-6)
