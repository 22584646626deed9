"""Query results and SQL results, compared as multisets of rows."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd

SMALL = "/root/testdata/sf0.001"


def database(folder: str = SMALL):
    c = duckdb.connect()
    c.execute("set temp_directory=''")
    for path in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


def _value(x):
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
        return None
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return f"{float(x):.9g}"
    return str(x)


def rows(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    return sorted(tuple("" if (v := _value(x)) is None else v for x in r) for r in zip(*[frame[c] for c in columns])) if len(frame) else []


def differences(query, statement: str, spark, folder: str = SMALL) -> str:
    got, wanted = query(spark, folder).toPandas(), database(folder).execute(statement).df()
    if sorted(got.columns) != sorted(wanted.columns):
        return f"columns {sorted(got.columns)} and {sorted(wanted.columns)}"
    a, b = rows(got), rows(wanted)
    return "" if a == b else f"{len(a)} and {len(b)} rows; {sorted(set(a) - set(b))[:3]} and {sorted(set(b) - set(a))[:3]}"
