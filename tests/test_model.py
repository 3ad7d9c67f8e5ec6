"""Boosting, TreeSHAP, recursive forecast and target encoding."""

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from conftest import approx
from pricelens.operators.boosting import QuantileBoostModel, fit_quantile_models, predict_column
from pricelens.operators.histograms import Schedule
from pricelens.operators.shap import ensemble_shap
from pricelens.operators.training import apply_target_encoding, fit_target_encoding, fold_target_encodings
from pricelens.operators.trees import MISSING, Tree


def test_target_encoding_fixture(spark):
    tr = spark.createDataFrame([("A", 1.0), ("A", 3.0), ("B", 10.0), ("C", 4.0), ("C", 4.0)], "p string, y double")
    enc = fit_target_encoding(tr, "p", "y")
    out = apply_target_encoding(spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "p string"), enc, "p", "e")
    got = {r.p: r.e for r in out.collect()}
    assert approx(got["A"], 2.125786) and approx(got["B"], 10.0) and approx(got["C"], 4.0) and approx(got["D"], 4.4)


def _data(spark, n=600):
    df = spark.range(n).select(F.col("id").alias("row_id"), F.rand(1).alias("a"), F.rand(2).alias("b"))
    df = df.withColumn("label", F.col("a") * 4 + F.when(F.col("b") > 0.5, 1.0).otherwise(0.0) + F.randn(3) * 0.3)
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)


def test_quantile_boosting_orders_and_improves(spark):
    d = _data(spark)
    valid = F.col("row_id") % 5 == 0
    models = fit_quantile_models(d, {"lower": 0.1, "median": 0.5, "upper": 0.9}, ["a", "b"],
                                 Schedule(rounds=20, learning_rate=0.2, leaves=8, min_leaf=10, feature_fraction=1.0), valid=valid)
    va = d.where(valid)
    assert models["median"].history[-1] < models["median"].history[0]
    p = predict_column(va, models).toPandas()
    assert (p.pred_lower <= p.pred_median).all() and (p.pred_median <= p.pred_upper).all()
    cover = ((p.label >= p.pred_lower) & (p.label <= p.pred_upper)).mean()
    assert 0.5 < cover <= 1.0
    # round trip through the persisted form
    m2 = QuantileBoostModel.from_json(models["median"].to_json())
    X = np.vstack(p["features"].apply(lambda v: v.toArray()).values)
    assert np.allclose(m2.predict_numpy(X), p.pred_median.values)


def test_tree_shap_additivity_and_exact_small_tree():
    # x0 <= 0.5 ? (x1 <= 0.5 ? 1 : 2) : 4, covers 10 / 6 (3, 3) / 4
    t = Tree(np.array([0, 1, -1, -1, -1]), np.array([0.5, 0.5, 0, 0, 0]), np.array([1, 2, -1, -1, -1]),
             np.array([4, 3, -1, -1, -1]), np.array([0, 0, 1.0, 2.0, 4.0]), np.array([10, 6, 3, 3, 4.0]))
    m = QuantileBoostModel(0.5, 0.0, [t], ["x0", "x1"])
    X = np.array([[0.2, 0.8], [0.9, 0.1]])
    phi, base = ensemble_shap(m, X)
    assert approx(base, (3 * 1 + 3 * 2 + 4 * 4) / 10)
    assert np.allclose(phi.sum(axis=1) + base, m.predict_numpy(X))
    # brute-force Shapley with path-dependent conditional expectations
    def f(x, S):
        def rec(n):
            if t.feature[n] < 0:
                return t.value[n]
            fe = t.feature[n]
            if fe in S:
                return rec(t.left[n] if x[fe] <= t.threshold[n] else t.right[n])
            return (t.cover[t.left[n]] * rec(t.left[n]) + t.cover[t.right[n]] * rec(t.right[n])) / t.cover[n]
        return rec(0)
    x = X[0]
    phi0 = 0.5 * (f(x, {0}) - f(x, set())) + 0.5 * (f(x, {0, 1}) - f(x, {1}))
    assert approx(phi[0, 0], phi0, 1e-9)


def test_shap_matches_brute_force_with_levels_missing_values_and_repeated_features():
    # a level set, a missing value that goes right, a feature tested twice on one path
    t = Tree(np.array([0, 1, -1, 0, -1, -1, -1]), np.array([0.5, 0, 0, 0.2, 0, 0, 0]), np.array([1, 2, -1, 4, -1, -1, -1]),
             np.array([6, 3, -1, 5, -1, -1, -1]), np.array([0, 0, 1.0, 0, 3.0, -2.0, 4.0]), np.array([20, 12, 5, 7, 3, 4, 8.0]),
             np.array([False, False, False, True, False, False, False]), {1: [0, 2]})
    X = np.array([[0.1, 2.0], [0.3, 1.0], [MISSING, 0.0], [0.9, 7.0], [0.1, MISSING], [0.5, 1.0], [0.1, 2.0]])
    left = t.goes_left(X)

    def value(x, known):
        def at(node):
            f = t.feature[node]
            if f < 0:
                return t.value[node]
            if f in known:
                return at(t.left[node] if left[x, node] else t.right[node])
            return (t.cover[t.left[node]] * at(t.left[node]) + t.cover[t.right[node]] * at(t.right[node])) / t.cover[node]
        return at(0)
    m = QuantileBoostModel(0.5, 1.5, [t, t], ["a", "b"])
    phi, base = ensemble_shap(m, X)
    for x in range(len(X)):
        one = [0.5 * (value(x, {0}) - value(x, set())) + 0.5 * (value(x, {0, 1}) - value(x, {1})),
               0.5 * (value(x, {1}) - value(x, set())) + 0.5 * (value(x, {0, 1}) - value(x, {0}))]
        assert np.allclose(phi[x], 2 * np.array(one))
    assert np.allclose(phi.sum(axis=1) + base, m.predict_numpy(X))
    # all trees at once, and the persisted form
    assert t.apply(X).tolist() == [2, 5, 6, 6, 4, 5, 2]
    again = QuantileBoostModel.from_json(m.to_json())
    assert np.allclose(again.predict_numpy(X), m.predict_numpy(X)) and again.trees[0].sets == t.sets


def test_fold_encodings_match_one_fold_at_a_time(spark):
    rows = [(f"p{i % 5}", i % 3, float(i * i % 17)) for i in range(40)] + [("rare", 1, 3.0), (None, 2, 1.0)]
    df = spark.createDataFrame(rows, "p string, fold int, y double")
    enc, means = fold_target_encodings(df, "p", "y", 3)
    got = {r.p: r.encoded for r in enc.collect()}
    for k in range(3):
        want = {r.p: (r.encoded, r.global_mean) for r in fit_target_encoding(df.where(F.col("fold") != k), "p", "y").collect()}
        for p, values in got.items():
            assert (values[k] is None) == (p not in want) and (p not in want or approx(values[k], want[p][0]))
        assert approx(means[k], next(iter(want.values()))[1])


def test_running_moments_match_the_whole_buffer():
    from pricelens.operators.recursive import Trail
    rng = np.random.default_rng(4)
    steps = np.exp(rng.normal(0, 0.02, (5, 60)).cumsum(axis=1)) * np.array([[1.0], [900.0], [1e6], [50.0], [3.0]])
    steps[4] = 3.0                                   # a price that never moves
    trail = Trail(steps[:, 0], 60)
    for t in range(1, 60):
        trail.append(steps[:, t])
        for a in {0, max(0, t - 2), max(0, t - 23), t // 2}:
            part = steps[:, a:t + 1]
            if part.shape[1] >= 2:
                x = np.arange(part.shape[1]) - (part.shape[1] - 1) / 2
                assert np.allclose(trail.slope_x12(a, t + 1), (x * part).sum(axis=1) / (x * x).sum() * 12, rtol=1e-7, atol=1e-7)
                assert np.allclose(trail.spread(a, t + 1), part.std(axis=1), rtol=1e-5, atol=1e-6)
