"""Every query with a SQL twin gives the same rows in DuckDB."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import connect, difference

FOLDER, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


#: Fits of whole models; their classifiers have tests of their own, and ``checks.compare`` runs these too.
FITS = {name for name in SQL if name.endswith(("classifier_rows", "network_rows", "forest_rows", "boosting_rows"))}


@pytest.mark.parametrize("name", sorted(set(SQL) - FITS))
def test_same_rows(spark, duck, name):
    problem = difference(QUERIES[name](spark, FOLDER), duck, SQL[name])
    if problem == "no rows":  # too little data: the next size must have some
        problem = difference(QUERIES[name](spark, LARGER), connect(LARGER), SQL[name])
    assert problem is None


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0 and "PurchaseSession" in df.columns


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)
