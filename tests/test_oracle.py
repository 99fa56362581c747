"""Every registered query against its SQL on the smallest sample tables."""

import os

import pytest
from compare import connect, difference

import __spark_entry__ as contract
from catalog import queries as catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# In the smallest tables a province has too few complete rows for five predictors.
LARGER = {
    name: "/root/testdata/sf0.01" for name in ("ols_by_province", "ols_summary_by_province", "vif_by_province")
}
QUERIES, SQL = contract.queries(), contract.oracle_sql()
TABLES = catalog.registered()


def test_every_query_has_sql():
    assert set(TABLES) <= set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(TABLES))
def test_query_matches_sql(spark, name):
    folder = LARGER.get(name, FOLDER)
    with connect(folder) as con:
        assert difference(QUERIES[name](spark, folder), con, SQL[name]) is None


def test_entry_has_rows(spark):
    assert contract.entry(spark).limit(1).count() == 1
