"""The text queries against their SQL, and two runs of the others against each other."""

import pytest
from oracle import DATA, same

from siltmill.llm import queries, sql


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_against_sql(spark, name):
    same(spark, queries.queries()[name], sql.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(sql.oracle_sql())))
def test_runs_alike(spark, name):
    one, two = (queries.queries()[name](spark, str(DATA)) for _ in range(2))
    assert one.schema == two.schema
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))
