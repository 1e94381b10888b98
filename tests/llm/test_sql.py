"""Queries that SQL can express."""

import pytest

from compare import connect, rows
from lumenframe.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, sf_dir, name):
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), connect(sf_dir).execute(queries.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_operator_has_one_query():
    from __spark_entry__ import queries as registered
    names = list(registered())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names
