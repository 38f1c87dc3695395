"""Registered queries against their SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract
from oddlot.plans.catalogue import SQL
from tests.conftest import SMALL

TABLES = ["events", "lineitem", "orders", "customer", "supplier"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    clean = lambda v: None if pd.isna(v) else str(v) if isinstance(v, str) else float(v)
    out = [tuple(clean(v) for v in r) for r in pdf.itertuples(index=False)]
    return sorted(out, key=lambda r: [(v is not None, str(type(v)), v if v is not None else 0) for v in r])


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = contract.queries()[name](spark, SMALL).toPandas()
    want = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0
