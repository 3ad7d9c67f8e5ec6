"""Plan-shape guards: pushdown, pruning, shuffle count, bounded broadcasts."""

import re

from pricelens.plans.registry import all_queries

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_plan_shape(spark):
    plan = _plan(all_queries()["real_price_trends"].build(spark, SF))
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(l_shipdate", plan)
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double,l_extendedprice:double,l_shipdate:" in plan
    # one shuffle for the monthly partial aggregate, one on item_id shared by
    # the windows and the final aggregate
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_no_cross_joins_or_row_udfs(spark):
    for name, q in all_queries().items():
        if q.oracle is None:
            continue
        plan = _plan(q.build(spark, SF))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name
