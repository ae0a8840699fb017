"""Every registered query against its SQL twin, on the smallest tables."""

import decimal

import duckdb
import pytest

from riskweave.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value) if value % 1 else int(value)
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return str(value)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_same_rows(spark, duck, name):
    frame = catalog.plans()[name](spark, SF)
    columns = sorted(frame.columns)
    result = duck.execute(catalog.oracles()[name])
    theirs = [c[0] for c in result.description]
    assert sorted(theirs) == columns
    places = [theirs.index(c) for c in columns]
    expected = sorted(tuple(plain(row[i]) for i in places) for row in result.fetchall())
    actual = sorted(tuple(plain(row[c]) for c in columns) for row in frame.collect())
    assert actual == expected


def test_rows_only_queries(spark):
    for name in set(catalog.plans()) - set(catalog.oracles()):
        assert catalog.plans()[name](spark, SF).count() > 0


def test_every_oracle_has_a_query():
    assert set(catalog.oracles()) <= set(catalog.plans())
