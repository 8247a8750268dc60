"""Comparison of a query's rows with DuckDB's for its SQL."""

import duckdb
import numpy as np
import pandas as pd

from marquee.plans.fixtures import TABLES

FOLDER = "/root/testdata/sf0.001"


def connect(folder: str = FOLDER):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def _value(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
        return ""
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (int, float, np.integer, np.floating)):
        return f"{round(float(x), 5) + 0.0:.5f}"
    if isinstance(x, (list, np.ndarray)):
        return str([_value(v) for v in x])
    return str(x)


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].astype(object).map(_value)
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def assert_same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    a, b = canonical(got), canonical(want)
    assert list(a.columns) == list(b.columns)
    assert len(a) == len(b)
    differ = (a != b).any(axis=1)
    assert not differ.any(), f"{a[differ].head()}\n{b[differ].head()}"
