"""Every core query against its SQL on the smallest tables; those without SQL must run with a stable schema."""

import pytest
from oracle import DATA, same

from siltmill.plans import corpus_queries, curation_queries, ledger_queries, ranking_queries, record_queries, record_sql, response_queries, scoring_queries

PLANS = (corpus_queries, ranking_queries, scoring_queries, ledger_queries, curation_queries, response_queries)
QUERIES = dict(record_queries.queries())
SQL = dict(record_sql.oracle_sql())
for m in PLANS:
    QUERIES |= m.queries()
    SQL |= m.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    same(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    one, two = QUERIES[name](spark, str(DATA)), QUERIES[name](spark, str(DATA))
    assert one.schema == two.schema
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
