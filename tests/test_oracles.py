"""Every registered query against its SQL counterpart on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as driver
import scenarios

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES, ORACLES = scenarios.QUERIES, scenarios.ORACLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, bool) or type(value).__name__ == "bool":
        return str(bool(value))
    return repr(float(value) + 0.0) if isinstance(value, (int, float)) else str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, cursor.fetchall())


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["user_id", "event_id", "reasons"]
    assert not df.isEmpty()


def test_source_order_of_repeated_and_odd_paths(spark, tmp_path):
    """Equal addresses, addresses that say something, large numbers and a missing address have one place each, as in the SQL."""
    urls = ["https://x.org/a#top", "http://y.org/Cycling_3/A1/run_Part4_9.html", "http://y.org/t_B2_C3_Channel_7.html", "z_9/", None]
    pages = [(k * 5 + 4 - 5 * 40, urls[k % len(urls)]) for k in range(80)] + [(10 * 2**31 + k, "u") for k in range(40)]
    spark.createDataFrame(pages, "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    cursor = con.execute(ORACLES["s9_source_order"])
    columns = [c[0] for c in cursor.description]
    want = rows(columns, cursor.fetchall())
    got = QUERIES["s9_source_order"](spark, str(tmp_path))
    assert rows(got.columns, got.collect()) == want and len(want) == 120
    # The tables' own order decides nothing: equal paths follow their page.
    place = {r["page_id"]: r["place"] for r in got.collect()}
    top = [p for p, u in pages if u == urls[0]]
    assert [place[p] for p in sorted(top)] == sorted(place[p] for p in top)
