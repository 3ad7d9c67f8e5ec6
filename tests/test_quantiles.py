"""Exact quantiles by counted buckets."""

import random

import numpy as np
import pytest

from pricelens.operators.aggregates import exact_quantile, group_median


@pytest.mark.parametrize("few", [False, True])
def test_quantiles_match_sorting(spark, few):
    rng = random.Random(1)
    rows = []
    for g in ("a", "b", None, "one", "equal", "wide"):
        n = {"one": 1, "equal": 50, "wide": 400}.get(g, 301)
        for _ in range(n):
            v = 7.25 if g == "equal" else rng.uniform(-1e6, 1e6) if g == "wide" else round(rng.choice([-1, 1]) * rng.expovariate(0.02), 2)
            rows.append((g, v))
    rows += [("a", None), ("a", float("nan")), ("none", None), ("edge", 0.0), ("edge", -0.0), ("edge", 1e-12), ("edge", -1e-12), ("edge", 1e300)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r for r in exact_quantile(df, ["g"], "v", {"q10": 0.1, "q50": 0.5, "q95": 0.95}, few_groups=few).collect()}
    groups = {}
    for g, v in rows:
        if v is not None and v == v:
            groups.setdefault(g, []).append(v)
    assert set(got) == set(groups) and "none" not in got
    for g, values in groups.items():
        for name, q in (("q10", 0.1), ("q50", 0.5), ("q95", 0.95)):
            assert np.isclose(got[g][name], np.quantile(values, q), rtol=1e-12, atol=1e-15), (g, name)
    whole = [v for values in groups.values() for v in values]
    assert np.isclose(group_median(df, [], "v", "m").first().m, np.median(whole), rtol=1e-12)
    assert exact_quantile(df.limit(0), ["g"], "v").count() == 0


def test_market_index_needs_few_exchanges(spark):
    from pricelens.plans.registry import all_queries
    df = all_queries()["market_index"].build(spark, "/root/testdata/sf0.001")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    exchanges = [line for line in plan.splitlines() if "ReusedExchange" not in line and ("Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line or "Exchange SinglePartition" in line)]
    assert not any("range" in line for line in exchanges) and len(exchanges) <= 6
