"""Every registered query runs on sf0.001 and, where an oracle exists, equals DuckDB exactly."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from basketry.plans.registry import QUERIES
from tests.conftest import SMALL
from tools.oracle_check import TABLES, rows_duck, rows_spark


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SMALL}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SMALL)
    cols, rows = rows_spark(df)
    sql = E.oracle_sql().get(key)
    if sql is None:
        assert len(cols) > 0
        return
    dcols, drows, _ = rows_duck(con, sql)
    assert cols == dcols
    assert Counter(rows) == Counter(drows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "total_revenue" in df.columns
