"""Variable features of counts: planted ones, local fits against a direct solution, odd tables."""

import numpy as np

from corvellum.operators import variable


def test_local_fit_follows_a_quadratic_and_ignores_far_points():
    rng = np.random.default_rng(0)
    x = np.sort(rng.uniform(-2, 3, 200))
    y = 1 + 2 * x - 0.5 * x**2
    assert np.allclose(variable.local_fit(x, y, np.ones(200), x), y, atol=1e-8)
    far = y.copy()
    far[x > 2.5] += 100
    assert np.allclose(variable.local_fit(x, far, np.ones(200), x[:50]), y[:50], atol=1e-8)
    # a point that counts twice is the same as two points
    twice = variable.local_fit(np.append(x, x[7]), np.append(y, y[7]) + 0, np.ones(201), x[:3], 1.0)
    assert np.allclose(twice, y[:3], atol=1e-6)


def _counts(spark, seed=0, units=300, features=200):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(features):
        rate = rng.uniform(2, 30)
        level = np.where(np.arange(units) % 4 == 0, 4.0, 0.5) if g < 10 else np.ones(units)
        values = rng.poisson(rate * level)
        rows += [(f"u{u}", f"G{g:03}", float(v)) for u, v in enumerate(values) if v]
    obs = spark.createDataFrame([(f"u{u}", "ab"[u // 4 % 2]) for u in range(units)], "unit_id string, batch string")
    return spark.createDataFrame(rows, "unit_id string, feature_id string, value double"), obs


def test_planted_features_come_first(spark):
    expr, obs = _counts(spark)
    whole = variable.variable_counts(expr, obs.selectExpr("unit_id", "'all' AS batch"), 10).collect()
    assert {r.feature_id for r in whole} == {f"G{g:03}" for g in range(10)} and [r.place for r in whole] == list(range(1, 11))
    by_batch = variable.variable_counts(expr, obs, 10).collect()
    assert {r.feature_id for r in by_batch} == {f"G{g:03}" for g in range(10)} and all(r.n_batches == 2 for r in by_batch)


def test_odd_tables(spark):
    expr, obs = _counts(spark, units=20, features=5)
    more = expr.union(spark.createDataFrame([("u0", "none", None), ("u1", "none", 0.0), ("nobody", "G000", 9.0)], expr.schema))
    flat = more.union(obs.selectExpr("unit_id", "'flat' AS feature_id", "CAST(3 AS DOUBLE) AS value"))
    lone = obs.union(spark.createDataFrame([("x", "lone")], obs.schema))
    got = variable.variable_counts(flat, lone, 50).collect()
    assert {r.feature_id for r in got} == {f"G{g:03}" for g in range(5)}
    assert variable.variable_counts(expr.where("false"), obs, 5).count() == 0
