"""Planted groups stand when the analysis changes."""

import numpy as np

from corvellum.plans.perturb import perturbed, robustness


def test_groups_stand(spark):
    rng = np.random.default_rng(0)
    rows = [(u, f"f{j}", float(rng.poisson(12 if j // 10 == u % 3 else 2))) for u in range(60) for j in range(30)]
    expr = spark.createDataFrame([r for r in rows if r[2] > 0], "id long, feature_id string, value double")
    got = perturbed(expr, n_features=20, n_components=4, resolution=0.4, k=8, specs=({"name": "fewer units", "share": 0.8}, {"name": "seed", "seed": 1}))
    assert {r.name for r in got.collect()} == {"fewer units", "seed"}
    assert robustness(got).first().verdict in ("robust", "sensitive")
