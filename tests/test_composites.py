"""Stages and the worked example find what was planted."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corvellum.plans import composites as c


def test_worked_example(spark):
    table, summary = c.worked_example(spark)
    called = {r.feature for r in table.where("called").collect()}
    planted = {f"P{i:04d}" for i in range(40)}
    assert len(called & planted) >= 20 and len(called - planted) <= 5
    assert "S07" in summary and "S11" in summary


def test_trim(spark):
    terms = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.03)], "term string, p double")
    sets = spark.createDataFrame([("a", str(i)) for i in range(10)] + [("b", str(i)) for i in range(9)] + [("c", str(i)) for i in range(20, 30)], "term string, feature_id string")
    assert [r.term for r in c.trimmed(terms, sets).orderBy("p").collect()] == ["a", "c"]


def _study(spark, paired, seed=0, batch="b1", effect=3.0):
    """Cells of six samples and two types, A with two features that go up; values sparse, some cells without any."""
    rng = np.random.default_rng(seed)
    cells, values = [], []
    for d in range(6):
        for cond in ("c", "s"):
            sample = f"d{d}" if paired else f"{cond}{d}"
            for t in ("A", "B", "unassigned"):
                for k in range(30 if t == "A" else 15 if t == "B" else 2):
                    unit = f"{sample} {cond} {t}{k}"
                    cells.append((unit, sample, cond, batch if batch else cond, "AB"[k % 2], t))
                    for g in range(40):
                        v = rng.poisson((effect if t == "A" and cond == "s" and g < 2 else 1.0) * 0.6)
                        if v and k % 10:  # every tenth cell holds nothing
                            values.append((unit, f"G{g}", float(v)))
    return spark.createDataFrame(cells, "unit_id string, sample string, condition string, batch string, grp string, ptype string"), spark.createDataFrame(values, "unit_id string, feature string, value double")


@pytest.mark.parametrize("paired", [True, False])
def test_compare_finds_what_was_planted(spark, paired):
    cells, values = _study(spark, paired)
    tables, notes = c.compare_stage(cells, values, "c", "s")
    said = {n["check"]: n["status"] for n in notes}
    called = {(r.ptype, r.feature) for r in tables["result"].where("significant").collect()}
    assert called == {("A", "G0"), ("A", "G1")} and set(said) <= set(c.CATALOGUES["compare"])
    assert said["pairing"] == ("PASS" if paired else "INFO") and said["testable cell types"] == "PASS" and said["null check"] == "PASS"
    df = {r.df for r in tables["result"].collect()}
    assert df == ({5} if paired else {10})
    # cells are counted, not stored values: every tenth cell has none, and shares are those of cells
    shares = {round(r.share, 6) for r in tables["shares"].where("ptype = 'A'").collect()}
    assert shares == {round(30 / 47, 6)}
    assert {r.n_cells for r in tables["units"].where("ptype = 'A'").collect()} == {30}


def test_counts_can_be_compared_by_a_negative_binomial_model(spark):
    cells, values = _study(spark, True)
    tables, notes = c.compare_stage(cells, values, "c", "s", n_swaps=2, method="negative binomial")
    called = {(r.ptype, r.feature) for r in tables["result"].where("significant").collect()}
    assert {("A", "G0"), ("A", "G1")} <= called and len(called) <= 4 and "dispersion" in tables["result"].columns


def test_shares_count_cells_not_values(spark):
    cells = spark.createDataFrame([(f"{s}{k}", s, "cs"[i % 2], None, None, "A" if k else "B") for i, s in enumerate("wxyz") for k in range(11)], "unit_id string, sample string, condition string, batch string, grp string, ptype string")
    gate = c.apply(c.designs.gate("c", "s"), cells=cells)
    got = {r.ptype: round(r.share, 6) for r in c.apply(c.designs.shares("c", "s", 10, 1), cells=cells, gate=gate).collect()}
    assert got == {"A": round(10 / 11, 6), "B": round(1 / 11, 6)}
    assert gate.first().batch == "INFO" and not gate.first().paired


def test_a_confounded_batch_warns_and_few_samples_end_it(spark):
    cells, values = _study(spark, False, batch=None)
    tables, notes = c.compare_stage(cells, values, "c", "s", n_swaps=2)
    assert {n["check"]: n["status"] for n in notes}["condition vs batch"] == "WARN" and tables["result"].count() == 80
    few = cells.where("sample IN ('c0', 's0', 's1')")
    tables, notes = c.compare_stage(few, values, "c", "s")
    assert set(tables) == {"gate"} and notes[-1]["status"] == "FAIL"
    none = c.compare_stage(cells.where("condition = 'c'"), values, "c", "s")
    assert none[1][0]["status"] == "FAIL" and c.compare_stage(cells.where("false"), values, "c", "s")[1][0]["status"] == "FAIL"


def test_a_sample_with_few_cells_makes_the_design_unpaired(spark):
    cells, values = _study(spark, True)
    thin = cells.where("NOT (sample = 'd0' AND condition = 's' AND substr(unit_id, -1) <> '1')")
    gate = c.apply(c.designs.gate("c", "s"), cells=thin).first()
    assert (gate.n_samples, gate.n_both, gate.paired, gate.pairing) == (6, 5, False, "WARN")


def test_log_values_are_averaged_over_all_cells(spark):
    cells, values = _study(spark, True)
    tables, _ = c.compare_stage(cells, values.withColumn("value", F.log1p("value")), "c", "s", kind="log", n_swaps=2, min_effect=0.2)
    called = {(r.ptype, r.feature) for r in tables["result"].where("significant").collect()}
    assert called == {("A", "G0"), ("A", "G1")}


def test_logistic_models_solve_their_score_equations():
    from corvellum.operators import glm

    rng = np.random.default_rng(3)
    units = pd.DataFrame([(f"s{i}", k) for i in range(8) for k in "ab"], columns=["sample", "condition"])
    n = rng.integers(50, 200, len(units)).astype(float)[None, :]
    k = rng.binomial(n.astype(int), np.clip(rng.uniform(0.1, 0.6, (5, 1)) + 0.15 * (units["condition"] == "b").to_numpy(), 0, 1)).astype(float)
    for paired in (True, False):
        x = glm.design(units, "b", paired)
        found = glm.binomial(k, n, x)
        assert found["converged"].all() and (found["effect"] > 0).all()
    # two levels in closed form
    b = (units["condition"] == "b").to_numpy()
    odds = lambda y, m: np.log(y / (m - y))
    want = odds(k[:, b].sum(1), n[:, b].sum()) - odds(k[:, ~b].sum(1), n[:, ~b].sum())
    error = np.sqrt(sum(1 / k[:, s].sum(1) + 1 / (n[:, s].sum() - k[:, s].sum(1)) for s in (b, ~b)))
    assert np.allclose(found["effect"], want, atol=1e-6) and np.allclose(found["error"], error, atol=1e-6)


def test_negative_binomial_model(spark):
    from corvellum.operators import glm

    rng = np.random.default_rng(4)
    units = pd.DataFrame([(f"s{i}", k) for i in range(10) for k in "ab"], columns=["sample", "condition"])
    # one dispersion for all, equal sizes: without samples the coefficient is the log ratio of means
    y = rng.negative_binomial(5, 5 / (5 + 40.0), (6, 20)).astype(float)
    x = glm.design(units, "b", False)
    beta, _, _, done = glm.nb_fit(y, np.ones(20), x, np.full(6, 0.2))
    b = (units["condition"] == "b").to_numpy()
    assert done.all() and np.allclose(beta[:, 1], np.log(y[:, b].mean(1) / y[:, ~b].mean(1)), atol=1e-6)
    assert abs(np.median(glm._dispersion(y, np.full_like(y, 40.0), x)) - 0.2) < 0.1
    # planted effects of both signs, samples of their own level, depths that differ
    rows, depth = [], {u: rng.uniform(0.5, 2) for u in map(tuple, units.to_numpy())}
    level = {(f"s{i}", g): rng.uniform(0.5, 2) for i in range(10) for g in range(120)}
    for g in range(120):
        base, fold = rng.uniform(20, 300), 3.0 if g < 8 else 1 / 3 if g < 16 else 1.0
        for s, k in depth:
            m = base * level[s, g] * depth[s, k] * (fold if k == "b" else 1)
            v = float(rng.negative_binomial(10, 10 / (10 + m)))
            if v:
                rows.append(("T", s, k, f"G{g:03}", v))
    bulk = spark.createDataFrame(rows, "ptype string, sample string, condition string, feature string, total double")
    kept = spark.createDataFrame([("T", s, k) for s, k in depth], "ptype string, sample string, condition string")
    got = {r.feature: r for r in glm.negative_binomial(bulk, kept, "a", "b", True).collect()}
    assert len(got) == 120 and all(r.converged for r in got.values())
    planted = [got[f"G{g:03}"] for g in range(16)]
    assert all(abs(abs(r.log2fc) - np.log2(3)) < 0.6 and abs(r.stat) > 4 for r in planted) and all((r.log2fc > 0) == (i < 8) for i, r in enumerate(planted))
    others = np.array([got[f"G{g:03}"].stat for g in range(16, 120)])
    assert np.mean(np.abs(others) > 1.96) < 0.15 and 0.03 < np.median([r.dispersion for r in got.values()]) < 0.3
    assert glm.negative_binomial(bulk.where("false"), kept, "a", "b", True).count() == 0


def test_qc_and_features(spark):
    rng = np.random.default_rng(1)
    rows = [(f"u{u}", f"{'MT-' if g < 3 else 'G'}{g}", float(v)) for u in range(60) for g in range(40) if (v := rng.poisson(3 if g >= 3 else (12 if u < 5 else 1))) > 0]
    expr = spark.createDataFrame(rows, "unit_id string, feature_id string, value double")
    obs = expr.select("unit_id", F.lit("s").alias("sample")).distinct()
    tables, notes = c.qc_stage(expr, obs, "startswith(feature_id, 'MT-')", 5, 100, 15.0, 3)
    left = {r.unit_id for r in tables["expr"].select("unit_id").distinct().collect()}
    assert not left & {f"u{u}" for u in range(5)} and len(left) >= 50
    tables, notes = c.features_stage(tables["expr"], obs, 5)
    assert tables["variable"].count() == 5 and notes[0]["found"] == "counts"


def _groups(spark, n=180, features=90, shift=0.0, seed=0):
    """Three groups with thirty features each at eight times, in three batches, the last third of the features shifted by batch."""
    rng = np.random.default_rng(seed)
    rows, obs = [], []
    for u in range(n):
        rate = np.full(features, 4.0)
        rate[30 * (u % 3) : 30 * (u % 3) + 20] *= 8
        rate[features - 30 :] *= 1 + shift * (u // 3 % 3)
        x = rng.poisson(rate)
        rows += [(f"u{u}", f"G{g}", float(np.log1p(v))) for g, v in enumerate(x) if v]
        obs.append((f"u{u}", f"b{u // 3 % 3}", float(x.sum()), int((x > 0).sum())))
    return spark.createDataFrame(rows, "unit_id string, feature_id string, value double"), spark.createDataFrame(obs, "unit_id string, batch string, total double, n_genes int")


def test_scaled_vectors(spark):
    expr, obs = _groups(spark, 40, 30)
    obs = obs.unionByName(spark.createDataFrame([("none", "b0", 0.0, 0)], obs.schema))
    vec, width = c.scaled_vectors(expr, obs, expr.select("feature_id").distinct())
    x = np.array([r.v for r in vec.collect()])
    assert x.shape == (41, width) == (41, 30) and np.allclose(x.mean(0), 0, atol=1e-9) and np.allclose(x.std(0, ddof=1), 1, atol=1e-6)


def test_dimred_stage(spark):
    expr, obs = _groups(spark)
    selected = expr.select("feature_id").distinct()
    out, notes = c.dimred_stage(expr, obs, selected, "batch", max_pcs=12, runs=3, k=10, min_pcs=2)
    said = {r["check"]: (r["status"], r["found"]) for r in notes}
    assert said["number of PCs chosen from the data"][1].startswith("2 kept, 2 above") and said["variance threshold reached"][0] == "PASS"
    assert said["batch structure in PCs"][0] == said["neighbor graph fragments"][0] == said["chosen PCs beat shuffled data"][0] == "PASS"
    assert "batch correction effect" not in said and "UMAP finite" not in said
    shifted, obs = _groups(spark, shift=4.0)
    out, notes = c.dimred_stage(shifted, obs, selected, "batch", max_pcs=12, runs=2, k=10, min_pcs=2)
    said = {r["check"]: r["status"] for r in notes}
    assert said["batch structure in PCs"] == "INFO" and said["batch correction effect"] == "PASS"
    none = c.dimred_stage(expr, obs.drop("batch"), selected, correct=True, max_pcs=6, runs=2, min_pcs=2)[1]
    assert {r["check"]: r["status"] for r in none}["batch correction effect"] == "FAIL"


def test_assemble_stage(spark):
    expr = spark.createDataFrame([(f"u{i}", f"G{g}", float(i + g + 1)) for i in range(12) for g in range(5)], "unit_id string, feature_id string, value double")
    obs = spark.createDataFrame([(f"u{i}", "P" + str(i // 4)) for i in range(12)], "unit_id string, label string")
    columns = [(i, f"u{i}", "P" + str(i // 4)) for i in range(12)]
    said = lambda cols, **k: {r["check"]: r["status"] for r in c.assemble_stage(expr, spark.createDataFrame(cols, "pos int, id string, label string"), obs, **k)[1]}
    good = said(columns, declared="counts", expected={"units": 12, "features": 5, "label=P1": 4, "different label": 3})
    assert set(good.values()) == {"PASS", "INFO"} and good["label=P1"] == "PASS"
    shifted = said([(i, f"u{(i + 1) % 12}", lab) for i, _, lab in columns], declared="log2tpm", expected={"units": 13})
    assert shifted["column order vs metadata"] == "FAIL" and shifted["cell ID sets match metadata"] == shifted["unique cell IDs"] == "PASS"
    assert shifted["scale matches declaration"] == shifted["units"] == "FAIL"
    assert said([(i, "u0", None) for i in range(12)])["unique cell IDs"] == "FAIL" and said([(i, f"u{i}", None) for i in range(12)])["column order vs metadata"] == "WARN"


def test_enrichment_of_a_planted_set(spark):
    from corvellum.operators import sampling

    rng = np.random.default_rng(2)
    ranked = [(t, f"g{i}", float(rng.normal() + (3 if i < 20 and t == "A" else 0))) for t in "AB" for i in range(200)]
    sets = [("planted", f"G{i}") for i in range(20)] + [(f"other{k}", f"G{i}") for k in range(4) for i in rng.choice(np.arange(20, 200), 20, replace=False)] + [("small", "G1")]
    got = {(r.grp, r.term): r for r in sampling.enrichment(spark.createDataFrame(ranked, "grp string, feature_id string, stat double"), spark.createDataFrame(sets, "term string, feature_id string"), 1500).collect()}
    assert got["A", "planted"].fdr < 0.01 and got["A", "planted"].place == 1 and got["A", "planted"].nes > 2 and got["B", "planted"].p > 0.01
    assert not [k for k in got if k[1] == "small"] and all(r.fdr >= r.p - 1e-6 for r in got.values()) and min(r.p for k, r in got.items() if k[1] != "planted") > 0.005


def test_expectations_on_units(spark):
    from corvellum.operators import enrich
    from corvellum.plans.sqlplan import apply

    rng = np.random.default_rng(4)
    expr = [(f"u{u}", f"G{g}", float(v)) for u in range(60) for g in range(6) if (v := rng.poisson(6 if g < 2 and u < 20 else 1))]
    rules = [("up", "gene_up", "t", "x", "", "up", None, None, None), ("against", "gene_up", "t", "x", "y", "up", None, None, None), ("not up", "gene_up", "t", "x", "", "up", None, None, None), ("down", "gene_up", "t", "y", "x", "down", None, None, None), ("third", "fraction_range", "t", "x", "", "up", None, 0.3, 0.4), ("half", "fraction_range", "t", "x", "", "up", None, 0.5, 0.6), ("nobody", "gene_up", "t", "q", "", "up", None, None, None), ("no hits", "set_enriched", "t", "y", "", "up", None, None, None), ("hit", "set_enriched", "t", "x", "", "up", None, None, None)]
    wanted = [(e, f) for e in ("up", "against", "down", "nobody") for f in ("g0", "G1")] + [("not up", "G3"), ("not up", "G4"), ("no hits", "wnt"), ("hit", "wnt")]
    obs = [(f"u{u}", "t", "x" if u < 20 else "y" if u < 40 else "z") for u in range(60)]
    got = apply(enrich.unit_expectations(), rules=spark.createDataFrame(rules, "expectation string, kind string, col string, grp string, against string, direction string, min_fraction double, low double, high double"), wanted=spark.createDataFrame(wanted, "expectation string, feature_id string"), expr=spark.createDataFrame(expr, "unit_id string, feature_id string, value double"), obs=spark.createDataFrame(obs, "unit_id string, col string, grp string"), hits=spark.createDataFrame([("x", "Wnt signalling")], "grp string, term string"))
    assert {r.expectation: r.status for r in got.collect()} == {"up": "met", "against": "met", "not up": "not met", "down": "met", "third": "met", "half": "not met", "nobody": "not testable", "no hits": "not testable", "hit": "met"}


def test_cluster_stage(spark):
    expr, obs = _groups(spark, 120, 90)
    vec, width = c.scaled_vectors(expr, obs, expr.select("feature_id").distinct())
    out, notes = c.dimred_stage(expr, obs, expr.select("feature_id").distinct(), max_pcs=6, runs=1, min_pcs=2)
    batches = out["used"].join(obs, "unit_id").select("id", "batch")
    tables, notes = c.cluster_stage(out["used"], batches, expr, k=10, resolutions=(0.3,), boots=1)
    said = {r["check"]: r["status"] for r in notes}
    assert set(said) == set(c.CATALOGUES["cluster"]) and said["no dominant cluster"] == said["batch mixing within clusters"] == "PASS"
    found = {}
    for r in tables["clusters"].collect():
        found.setdefault(r.cluster, set()).add(int(r.unit_id[1:]) % 3)
    assert len(found) >= 3 and all(len(g) == 1 for g in found.values())  # greedy moves may split a group, but join none
    own = {}
    for r in tables["markers"].collect():
        own.setdefault(r.cluster, set()).add(int(r.feature_id[1:]))
    assert all(g < set(range(30 * next(iter(found[k])), 30 * next(iter(found[k])) + 20)) | set(range(60, 90)) for k, g in own.items()) and max(map(len, own.values())) >= 15


def test_annotate_stage(spark):
    rng = np.random.default_rng(3)
    on = {"0": range(0, 5), "1": range(10, 15), "2": range(20, 25), "3": []}
    expr = [(f"{g}_{u}", f"G{x}", float(v)) for g, own in on.items() for u in range(30) for x in range(30) if (v := np.log1p(rng.poisson(5 if x in own else 0.2)))]
    obs = spark.createDataFrame([(f"{g}_{u}", g) for g in on for u in range(30)], "unit_id string, grp string")
    panel = spark.createDataFrame([(f"T{t + 1}", f"g{x}", "+") for t in range(3) for x in range(10 * t, 10 * t + 5)] + [("T1", "G20", "-"), ("T9", "G99", "+")], "cell_type string, gene string, sign string")
    reference = spark.createDataFrame([(f"{g}_{u}", f"T{int(g) + 1}") for g in "012" for u in range(30)], "unit_id string, label string")
    tables, notes = c.annotate_stage(spark.createDataFrame(expr, "unit_id string, feature_id string, value double"), obs, panel, reference)
    assert {r.grp: r.label for r in tables["calls"].collect()} == {"0": "T1", "1": "T2", "2": "T3", "3": "unassigned"}
    said = {n["check"]: n["status"] for n in notes}
    assert set(said) == set(c.CATALOGUES["annotate"]) - {"pretrained annotation tools"}
    assert said["marker panel"] == said["panel strength"] == said["enough usable markers"] == "WARN"
    assert said["cells named"] == said["negative marker conflicts"] == said["data-driven marker support"] == said["reference agreement"] == "PASS"
    # a reference that says another type of the panel makes a name less sure, one that says something else doesn't
    other = spark.createDataFrame([(f"{g}_{u}", {"0": "t2", "1": "T2", "2": "something"}[g]) for g in "012" for u in range(30)], "unit_id string, label string")
    before = {r.grp: r.tier for r in tables["calls"].collect()}
    after = {r.grp: r.tier for r in c.annotate_stage(spark.createDataFrame(expr, "unit_id string, feature_id string, value double"), obs, panel, other)[0]["calls"].collect()}
    assert before["0"] == "confident" and after == before | {"0": "probable"}
    assert {r.gene for r in tables["suggested_negatives"].where("cell_type = 'T1'").collect()} == {f"G{x}" for x in (*range(10, 15), *range(21, 25), 99)}
