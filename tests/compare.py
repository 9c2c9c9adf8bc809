"""Runs queries and their SQL side by side on the smallest given tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

DATA = Path("/root/testdata/sf0.001")


def connection():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in DATA.glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(repr, df.where(df.notna(), None).itertuples(index=False, name=None)))


def compare(spark, name: str, query, sql: str | None) -> None:
    if not DATA.exists():
        pytest.skip("no test tables here")
    got = query(spark, str(DATA)).toPandas()
    if sql:
        assert rows(got) == rows(connection().sql(sql).df())
    else:
        assert len(got.columns)
