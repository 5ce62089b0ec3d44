"""Run a query and its SQL on the same files and compare the rows."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_numeric_dtype(df[c]) and not pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype("float64")
        else:
            df[c] = df[c].map(lambda x: None if x is None or x is pd.NA or (isinstance(x, float) and np.isnan(x)) else str(x))
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def differences(got: pd.DataFrame, want: pd.DataFrame, exact: bool = True) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    a, b = normal(got), normal(want)
    for c in a.columns:
        if a[c].dtype.kind == "f" and b[c].dtype.kind == "f":
            bad = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))
        else:
            bad = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))
        if bad.any():
            i = bad.idxmax()
            return f"{int(bad.sum())} of {len(a)} differ in {c}: {a.loc[i].to_dict()} vs {b.loc[i].to_dict()}"
    return None
