"""Comparing a query's rows with those of its SQL in DuckDB, without regard to their order."""

import os

import duckdb
import numpy as np
import pandas as pd


def connect(sf: str):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(sf):
        c.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return c


def rows(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()

    def text(v):
        if isinstance(v, (list, np.ndarray)):
            return str(list(v))
        if v is None or pd.isna(v):
            return "null"
        return repr(float(v)) if isinstance(v, (float, np.floating)) or (isinstance(v, (int, np.integer)) and not isinstance(v, bool)) else str(v)

    return df.map(text).sort_values(list(df.columns)).reset_index(drop=True)


def assert_same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(rows(got), rows(want))
