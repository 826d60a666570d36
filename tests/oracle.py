"""Test helper: a query against its SQL in DuckDB."""

import glob
import math
import os

import duckdb
import pandas as pd

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection(sf=SF):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rows_of(frame):
    """Sorted rows, columns by name, of a pandas frame."""

    def plain(v):
        if v is None or (not isinstance(v, str) and pd.isna(v)):
            return ""
        if hasattr(v, "year"):
            return str(pd.Timestamp(v).date())
        return f"{float(v) + 0.0:.5f}" if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind == "f" else str(v)

    return sorted(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


def assert_same(df, sql, sf=SF):
    a, b = df.toPandas(), connection(sf).execute(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    x, y = rows_of(a), rows_of(b)
    assert len(x) == len(y)
    for p, q in zip(x, y):
        for u, v in zip(p, q):
            try:
                assert math.isclose(float(u), float(v), rel_tol=1e-6, abs_tol=1e-4), (p, q)
            except ValueError:
                assert u == v, (p, q)
