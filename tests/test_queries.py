"""Every query of the core engine against its SQL; the others are in test_panels, test_networks and test_sources."""

import pytest

from ledgerline.plans.catalog import FLAGSHIP, QUERIES, SQL

from . import oracle


@pytest.fixture(scope="module")
def con(root):
    return oracle.connect(root)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, root, con, name):
    oracle.same(con, QUERIES[name](spark, root), SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert FLAGSHIP in QUERIES
    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(QUERIES) <= set(entry.queries())
