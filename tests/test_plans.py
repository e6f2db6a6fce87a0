"""Plan guards: no registered query may plan an all-pairs join."""
import pytest

from revlens.registry import QUERIES

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_all_pairs_join(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(f in plan for f in FORBIDDEN), name
