"""Comparison of a Spark result with DuckDB's over the same files."""

from collections import Counter

import duckdb
import numpy as np
import pandas as pd

from seqsieve.sources.views import TABLES


def rows(df: pd.DataFrame) -> Counter:
    def plain(v):
        if isinstance(v, (list, np.ndarray)):
            return str([plain(x) for x in v])
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, (float, np.floating)) and np.isnan(v)):
            return "NULL"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, (int, np.integer)):
            return str(int(v))
        return f"{v:.9g}" if isinstance(v, (float, np.floating)) else str(v)

    df = df[sorted(df.columns)]
    return Counter(tuple(plain(v) for v in r) for r in df.itertuples(index=False))


def expected(sql: str, sf_dir: str) -> pd.DataFrame:
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c.sql(sql).df()


def same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert a == b, (len(got), len(want), list((a - b))[:2], list((b - a))[:2])
