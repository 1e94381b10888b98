"""Every registered query against its SQL statement on the small tables."""

import pytest

from compare import connect, differences
from lumenframe.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, sf_dir, name):
    message, rows, *_ = differences(spark, con, name, sf_dir)
    assert message is None
    assert rows > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e
    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
