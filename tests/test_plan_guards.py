"""Scale guards: no registered query plans a cartesian product, a
broadcast nested-loop join or a Python UDF."""

import os

import pytest

SF = "/root/testdata/sf0.001"
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"]
# these run their job while building the frame; their returned plans are plain scans
SKIP = {"roundtrip_sink", "stream_classify_errors"}


def _keys():
    from errata.plans.registry import queries

    return sorted(k for k in queries() if k not in SKIP)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
@pytest.mark.parametrize("key", _keys())
def test_no_quadratic_or_python_nodes(spark, key):
    from __spark_entry__ import queries

    df = queries()[key](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    bad = [f for f in FORBIDDEN if f in plan]
    assert not bad, f"{key}: {bad}"
