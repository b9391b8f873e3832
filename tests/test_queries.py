"""Every query with SQL gives the rows of its SQL."""

import duckdb
import pytest

from vellum.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, sf_dir, name):
    frame = catalog.queries()[name](spark, sf_dir)
    told = duck.sql(catalog.oracle_sql()[name])
    columns = sorted(frame.columns)
    assert columns == sorted(told.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=str)
    places = [told.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in places) for r in told.fetchall()), key=str)
