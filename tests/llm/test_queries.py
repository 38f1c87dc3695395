"""Every query of the package that has SQL, against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from oddlot.llm.catalogue import QUERIES, SQL
from tests.conftest import SMALL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        db.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    cursor = db.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    want = sorted(map(str, cursor.fetchall()))
    df = QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == sorted(names)
    assert sorted(str(tuple(r)) for r in df.select(*(f"`{n}`" for n in names)).collect()) == want
