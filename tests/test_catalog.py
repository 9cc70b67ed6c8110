"""Every registered query of the code-analytics part against its SQL, at the smallest scale."""

import pytest

from compare import assert_same, connect
from gatewright.plans import catalog, catalog_sql

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog_sql.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    assert_same(spark, con, name, catalog.queries()[name], catalog_sql.oracle_sql()[name], SF)
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_has_rows(con, name):
    """A comparison of nothing with nothing would prove nothing."""
    assert con.execute(f"SELECT count(*) FROM ({catalog_sql.oracle_sql()[name]}) q").fetchone()[0] > 0
