"""Every registered corpus query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as driver
from streamloom.llm.queries import ORACLES, QUERIES
from tests.llm.helpers import DRIVER_FOLDER
from tests.test_oracles import TABLES, rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DRIVER_FOLDER}/{t}.parquet'")
    got = QUERIES[name](spark, DRIVER_FOLDER)
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, cursor.fetchall())


def test_registered():
    assert set(QUERIES) <= set(driver.queries())
