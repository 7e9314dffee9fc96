"""Every registered query against its SQL, on the small tables."""

import math
import os

import duckdb
import pytest

from marginalia.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(rows):
    cell = lambda x: round(x, 6) if isinstance(x, float) and math.isfinite(x) else str(x) if hasattr(x, "year") else x
    return sorted((tuple(map(cell, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = db.execute(f"select {', '.join(columns)} from ({catalog.SQL[name]}) q").fetchall()
    rows = plain(got.select(*columns).collect())
    assert rows, "no rows"
    assert rows == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
