"""Plan shapes: no nested loops, no cross products, no Python in batch operators, filters at the scan."""

import pytest

from parlor.workload import registry
from parlor.workload.fixtures import Tables
from tools.plans import problems

FOLDER = "/root/testdata/sf0.001"
BATCH = [n for n in registry.queries() if not n.startswith("stream_")]


@pytest.mark.parametrize("name", BATCH)
def test_no_bad_shape(spark, name):
    plan = registry.queries()[name](Tables(spark, FOLDER))._jdf.queryExecution().executedPlan().toString()
    assert not problems(plan)


def test_tenant_filter_reaches_the_scan(spark):
    t = Tables(spark, FOLDER)
    plan = registry.queries()["unread_direct"](t).where("owner_id = 'u1'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(owner_id,u1)") >= 2
    assert "metadata" not in plan.split("ReadSchema")[1]
