"""Every registered query against its SQL, at the smallest scale."""

from __future__ import annotations

import pytest

from weftline.plans import registry
from weftline.plans.inputs import inputs
from weftline.session import table


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows_as_sql(name, same_as_sql):
    same_as_sql(registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(name, spark, sf_dir):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_search_runs_over_every_customer(spark):
    """At a scale with customers above 150: all are sources and targets, and the search leaves the first 150."""
    sf = "/root/testdata/sf0.01"
    ids = {r[0] for r in table(spark, sf, "customer").select("c_custkey").collect()}
    found = inputs(spark, sf, "all_edges").collect()
    assert len(ids) > 150 and {r.source for r in found} == ids == {r.target for r in found}
    reached = registry.QUERIES["bounded_reach_all"](spark, sf).collect()
    assert {r.depth for r in reached} == {0, 1, 2, 3} and max(r.id for r in reached) > 150 and sum(r.depth == 0 for r in reached) > 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
