"""Every registered query against its SQL; those without SQL must give rows."""

import pytest

from oracle import assert_same
from weftline.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_sql(spark, name):
    assert_same(spark, SF, catalog.QUERIES[name], catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
