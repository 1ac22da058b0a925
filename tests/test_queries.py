"""Registered queries against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from sidelines.plans.catalog import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def rows(df):
    def text(v):
        return "null" if pd.isna(v) else f"{v + 0.0:.6f}" if isinstance(v, float) else str(v)

    return sorted(tuple(text(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        c.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(duck.execute(ORACLE_SQL[name]).fetchdf())


def test_registry_runs_without_training_data_operators(spark):
    assert set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
