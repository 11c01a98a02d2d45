from __future__ import annotations

import pytest
from oracle import compare

from cashloom.plans import registry


def test_every_sql_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_agrees_with_sql(spark, data, name):
    compare(spark, data, registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", ["jn5_greedy", "jn6_assignment", "mat4_candidates", "src11_generated", "str5_similarity"])
def test_other_queries_run(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() >= 0


def test_entry_has_rows(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
