import os

import duckdb
import pytest

import __spark_entry__ as entry
from strandlab.plans import registry

DATA = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


def rounded(rows):
    return sorted(tuple("null" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(DATA):
        path = f"{DATA}/{t}" + ("/*.parquet" if os.path.isdir(f"{DATA}/{t}") else "")
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from '{path}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    mine = registry.queries()[name](spark, DATA).toPandas()
    theirs = duck.sql(SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    columns = sorted(mine.columns)
    assert rounded(mine[columns].astype(object).itertuples(index=False)) == rounded(theirs[columns].astype(object).itertuples(index=False))


def test_entry_names():
    assert set(registry.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
