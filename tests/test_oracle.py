"""Every registered query with a SQL twin agrees with DuckDB (sf0.001)."""

import duckdb
import pytest

import __spark_entry__ as entry
from resolva.sources.tables import TABLES
from tools.oracle_check import compare

from .conftest import SF_SMALL

ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_contract(spark):
    qs = entry.queries()
    assert set(ORACLE) <= set(qs)
    df = entry.entry(spark)
    assert df.count() > 0
    assert "f1_macro" in df.columns and "roc_auc" in df.columns


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    got = entry.queries()[name](spark, SF_SMALL).toPandas()
    want = con.execute(ORACLE[name]).df()
    ok, msg = compare(got, want)
    assert ok, msg
