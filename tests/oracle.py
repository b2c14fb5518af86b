"""Comparison of a Spark frame with DuckDB's answer to SQL over the same tables."""

import duckdb
import pandas as pd

from tidemark.tables import TABLES


def connect(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def _cell(v):
    if isinstance(v, float):
        return None if pd.isna(v) else repr(float(v))
    return None if v is None or v is pd.NaT else str(v)


def rows(frame):
    return sorted((tuple(_cell(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


def assert_same(spark_frame, con, sql):
    got, want = spark_frame.toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
