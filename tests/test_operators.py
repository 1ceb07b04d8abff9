"""Operators on small relations with known answers."""

import numpy as np
from pyspark.sql import functions as F

from corvellum.operators import enrich, inference, matrix, ranks, records
from corvellum.plans.sqlplan import apply


def test_bh_of_four(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.2), ("e", None)], "id string, p double")
    rows = {r.id: r for r in apply(inference.multiplicity(), p=p).collect()}
    assert [round(rows[k].bh, 4) for k in "abcd"] == [0.04, 0.0533, 0.0533, 0.2]
    assert [round(rows[k].holm, 4) for k in "abcd"] == [0.04, 0.09, 0.09, 0.2] and "e" not in rows


def test_best_jaccard(spark):
    same = spark.createDataFrame([("x", "0"), ("x", "0"), ("x", "0"), ("y", "1"), ("y", "1"), ("y", "1")], "a string, b string")
    assert {r.a: r.jaccard for r in apply(inference.best_jaccard(), labels=same).collect()} == {"x": 1.0, "y": 1.0}
    moved = spark.createDataFrame([("x", "0"), ("x", "0"), ("x", "1"), ("y", "1"), ("y", "1"), ("y", "1")], "a string, b string")
    assert {r.a: round(r.jaccard, 4) for r in apply(inference.best_jaccard(), labels=moved).collect()} == {"x": 0.6667, "y": 0.75}


def test_scales(spark):
    counts = spark.createDataFrame([("u", f"f{i}", float(i)) for i in range(9)], "unit_id string, feature_id string, value double")
    assert apply(matrix.detect_scale(), expr=counts).first().scale == "counts"
    logs = apply(matrix.normalise("counts"), expr=counts).select("unit_id", "feature_id", "value").where("value > 0")
    assert apply(matrix.detect_scale(), expr=logs).first().scale == "log1p_cp10k"


def test_generic_terms(spark):
    terms = spark.createDataFrame([("Ribosome",), ("Aminoacyl-tRNA biosynthesis",), ("Asthma",), ("Some pathway [hsa05200]",), ("Some pathway hsa05200",), ("Cell cycle",), ("Wnt signalling",)], "term string")
    flags = {r.term: r.flag for r in apply(enrich.generic_terms(), terms=terms).collect()}
    assert flags["Ribosome"] == flags["Aminoacyl-tRNA biosynthesis"] == "housekeeping machinery" and flags["Cell cycle"] == flags["Wnt signalling"] == flags["Some pathway hsa05200"] == ""
    assert flags["Asthma"] == flags["Some pathway [hsa05200]"] == "disease or infection name; may reflect generic genes"


def test_file_roles(spark):
    want = {"counts.txt": "processed_matrix", "a.FQ.gz": "raw_reads", "x.cram": "raw_reads", "GSE1_series_matrix.txt": "sample_metadata", "samples.csv": "sample_metadata", "design_matrix.tsv": "sample_metadata", "Snakefile": "code", "a.Rmd": "code", "table.csv": "unknown", "log_normalized.h5ad": "processed_matrix"}
    files = spark.createDataFrame([(n,) for n in want], "name string")
    assert {r.name: r.role for r in apply(records.file_roles(), files=files).collect()} == want


def test_agreement_of_two_results(spark):
    """Planted: 20 up and 20 down in both, some noise; a result against itself, its mirror image, and too few ids."""
    rows = [(f"F{i}", 1.5 if i < 20 else -1.2 if i < 40 else 0.001 * (i % 7 - 3), 0.001 if i < 20 else 0.002 if i < 40 else 0.5) for i in range(300)]
    frame = lambda r: spark.createDataFrame(r, "id string, effect double, padj double")
    same = apply(inference.concordance(), a=frame(rows), b=frame([(i.lower(), e, p) for i, e, p in rows] + [("f1", -9.0, 0.9)])).first()
    assert (same.status, same.n_shared, same.sig_a, same.overlap, same.jaccard, same.same_direction) == ("tested", 300, 40, 40, 1.0, 1.0) and same.overlap_p < 1e-6 and same.effect_correlation == 1.0
    mirrored = apply(inference.concordance(), a=frame(rows), b=frame([(i, -e, p) for i, e, p in rows])).first()
    assert mirrored.same_direction == 0.0 and mirrored.effect_correlation < -0.9
    assert apply(inference.concordance(), a=frame(rows[:9]), b=frame(rows)).first().status == "not testable"



def test_rankings_read_their_rows_once(spark):
    """Rows that leave each input are counted; ids that repeat, ties, nulls, few shared ids and none, beside the one text."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for frame in batches:
            seen.add(len(frame))
            yield frame

    def frame(rows, counted=True):
        df = spark.createDataFrame(rows, "id string, effect double, padj double")
        return df.mapInPandas(count, df.schema) if counted else df

    a = [(f"f{i % 600}", None if i % 31 == 0 else float(i * 7 % 50 - 20), (i * 37 % 1009 + 1) / 1010) for i in range(700)]
    b = [(f"F{i + 100}", None if i % 29 == 0 else float(i * 11 % 40 - 20), (i * 41 % 1009 + 1) / 1010) for i in range(700)]
    got = ranks.concordance(frame(a), frame(b), 0.4).collect()
    assert seen.value == 1400 and got[0].n_shared > 400 and got[0].overlap > 50
    for x, y in ((a, b), (a[:9], b), (a[:50], b[-50:]), ([], b), ([(i, e, 1.0) for i, e, _ in a], b)):
        assert ranks.concordance(frame(x), frame(y), 0.4).collect() == apply(inference.concordance(0.4), a=frame(x, False), b=frame(y, False)).collect()
    xy = spark.createDataFrame([(None if i % 31 == 0 else float(i * 7 % 50), None if i % 29 == 0 else float(i * i % 83)) for i in range(700)], "x double, y double")
    seen.value = 0
    assert ranks.correlations(xy.mapInPandas(count, xy.schema)).collect() == apply(inference.correlations(), xy=xy).collect() and seen.value == 700


def test_expectations_on_a_result(spark):
    result = spark.createDataFrame([("A", 1.0, 0.01), ("B", 1.0, 0.02), ("C", 1.0, 0.9), ("D", -1.0, 0.01), ("E", 0.1, 0.6)], "feature string, effect double, padj double")
    rules = [("up", f, "up") for f in "abABAB"[:2]] + [("most", f, "up") for f in "ABC"] + [("down", f, "down") for f in "DE"] + [("quiet", f, "none") for f in "CE"] + [("loud", f, "none") for f in "CEA"] + [("few", "A", "up"), ("few", "Z", "up")]
    got = {r.name: (r.verdict, r.present, r.hits) for r in apply(inference.expectation_check(), rules=spark.createDataFrame(rules, "name string, feature string, direction string"), result=result).collect()}
    assert got == {"up": ("met", 2, 2), "most": ("not met", 3, 2), "down": ("not met", 2, 1), "quiet": ("met", 2, 0), "loud": ("not met", 3, 1), "few": ("not testable", 1, 1)}


def test_ranks_bin_by_bin(spark):
    """The bins that spare a window over all rows leave every rank and adjusted p as one window gives them."""
    rows = [(f"i{k:03d}", 0.001 * (k * k % 997) if k % 9 else 0.3, k % 3) for k in range(500)]
    got = {r.id: r for r in apply(inference.multiplicity("g"), p=spark.createDataFrame(rows, "id string, p double, g int")).collect()}
    for g in range(3):
        own = sorted((p, i) for i, p, h in rows if h == g)
        m, holm, bh = len(own), 0.0, {}
        low = 1.0
        for k in range(m, 0, -1):
            low = min(low, own[k - 1][0] * m / k)
            bh[own[k - 1][1]] = low
        for k, (p, i) in enumerate(own, 1):
            holm = max(holm, min(1.0, (m - k + 1) * p))
            assert abs(got[i].holm - holm) < 2e-6 and abs(got[i].bh - bh[i]) < 2e-6


def test_panel_score_leaves_out(spark):
    """A negative that is a positive too doesn't count, and a type without enough usable genes has no detection."""
    stats = spark.createDataFrame([("0", "G1", 1.0, 0.9), ("0", "G2", 1.0, 0.8), ("0", "G3", 0.9, 0.7), ("0", "G4", 0.0, 0.01), ("1", "G1", 0.0, 0.1), ("1", "G2", 0.0, 0.1), ("1", "G3", 0.0, 0.0), ("1", "G4", 1.0, 0.02)], "grp string, feature_id string, scaled double, detected double")
    panel = [("T1", "G1", "+"), ("T1", "g2", "+"), ("T1", "G3", "+"), ("T1", "G1", "-"), ("T2", "G1", "+"), ("T2", "G4", "+")]
    got = {(r.grp, r.cell_type): r for r in apply(enrich.panel_scores(), stats=stats, panel=spark.createDataFrame(panel, "cell_type string, gene string, sign string")).collect()}
    assert got["0", "T1"].negatives_on == 0 and got["0", "T1"].pos_detect == 1.0 and abs(got["0", "T1"].score - 0.966667) < 1e-6
    assert got["0", "T2"].score == got["0", "T2"].pos_detect == 0.0


def test_called_types(spark):
    rows = [("0", "T1", 0.9, 1.0, 0), ("0", "T2", 0.1, 0.0, 0), ("1", "T1", 0.5, 0.8, 0), ("1", "T2", 0.4, 0.8, 0), ("2", "T1", 0.5, 0.8, 0), ("2", "T2", 0.48, 0.8, 0), ("3", "T1", 0.2, 0.4, 0), ("4", "T1", 0.9, 1.0, 1)]
    scores = spark.createDataFrame([(*r, 60) for r in rows], "grp string, cell_type string, score double, pos_detect double, negatives_on int, n_cells int")
    assert {r.grp: r.tier for r in apply(enrich.called_types(), scores=scores).collect()} == {"0": "confident", "1": "probable", "2": "ambiguous", "3": "unassigned", "4": "ambiguous"}
    votes = spark.createDataFrame([("0", "T2"), ("1", "T2"), ("2", "T1"), ("3", "T1")], "grp string, vote string")
    voted = {r.grp: (r.label, r.tier) for r in apply(enrich.called_types(True), scores=scores, votes=votes).collect()}
    assert voted == {"0": ("T1", "probable"), "1": ("ambiguous", "ambiguous"), "2": ("ambiguous", "ambiguous"), "3": ("unassigned", "unassigned"), "4": ("ambiguous", "ambiguous")}
    agreed = votes.selectExpr("grp", "'T1' AS vote")
    assert {r.grp: r.tier for r in apply(enrich.called_types(True), scores=scores, votes=agreed).collect()} == {r.grp: r.tier for r in apply(enrich.called_types(), scores=scores).collect()}


def test_planted_set_is_found(spark):
    sets = spark.createDataFrame([("planted", f"G{i}") for i in range(20)] + [("other", f"G{i}") for i in range(100, 120)], "term string, feature_id string")
    ranked = spark.createDataFrame([(f"g{i}", (3.0 if i < 20 else 0.0) + (i * 37 % 101) / 101 - 0.5) for i in range(200)], "feature_id string, stat double")
    es = {r.term: r.es for r in apply(enrich.running_score(), sets=sets, ranked=ranked).collect()}
    assert es["planted"] > 0.95 and abs(es["other"]) < 0.6


def test_lint_rules(spark):
    from corvellum.operators import lint

    good = "import numpy as np\nrng = np.random.default_rng(0)\nfig, ax = subplots()\nax.scatter(x, y)\nax.bar(x, y)\nax.set_xlabel('a')\nax.set_ylabel('b')\nax.set_title('t')\nfig.savefig('a.svg')\nfig.savefig('a.png')\n# cmap='jet' yerr=2"
    scripts = {
        "good": (good, set()),
        "maps": ("a = 1\nb = plot_it(cmap = 'jet')\nc = cm.x", {("K3", 2)}),
        "neon": ("f('CYAN')", {("K2", 1)}),
        "bars": (good + "\nax.set_ylim(3, 4)", {("H3", 5)}),
        "pie": ("x\nax.pie(s, shadow=True)\nax.set_title('t')", {("H1", 2), ("H1b", 2)}),
        "3d": ("Axes3D", {("H2", 1)}),
        "seed": ("np.random.normal()", {("P3", None)}),
        "labels": ("ax.plot(x)\nax.set_xlabel('a')\nax.set_title('t')", {("S2", None)}),
        "error": ("yerr=2", {("E3", None)}),
        "panels": ("subplots(1, 2)", {("H9", None)}),
        "files": ("fig.savefig('a.png')", {("P2", None)}),
        "log": ("ax.semilogy(x)", {("H6", 1)}),
        "fill": ("d.fillna(0)", {("H8", 1)}),
        "plt": ("\nplt.savefig('a.png'); plt.savefig('a.pdf')", {("hyg", 2)}),
        "comment and text": ("# ax.pie(x, shadow=True)\nsay = 'ax.pie(x) and df.fillna(0)'", set()),
        "no shadow": ("ax.pie(s, shadow=False)\nax.set_title('t')", {("H1b", 1)}),
        "attribute map": ("c = plt.cm.jet_r", {("K3", 1)}),
        "axis from below": ("ax.bar(x)\nax.scatter(x, y)\nax.set(xlabel='a', ylabel='b')\nax.set_title('t')\nax.set_ylim(bottom=-3)", set()),
        "cut by name": ("ax.barh(x)\nax.scatter(x, y)\nax.set(xlabel='a', ylabel='b')\nax.set_title('t')\nax.set_xlim(left=0.5)", {("H3", 1)}),
        "seeded": ("np.random.seed(1)\nnp.random.normal()", set()),
        "seed by keyword": ("df.sample(5, random_state=1)", set()),
        "spread said": ("fig.suptitle('mean and 95% CI')\nax.errorbar(x, y, yerr=e)\nax.set(xlabel='a', ylabel='b')", set()),
        "one axis": ("subplots(nrows=2, sharex=True)", set()),
        "notebook": ("%matplotlib inline\n!ls\ndf.interpolate()", {("H8", 3)}),
        "broken": ("def f(:\n  pass", {("parse", 1)}),
        "null": (None, set()),
        "font": ("ax.text(1, 2, fontsize = 7.5)\nax.text(fontsize=8)", {("T1", 1)}),
        "title": ("ax.imshow(x)\nax.set(xlabel='a')\nax.set_ylabel('b')", {("T2", None)}),
        "thin": ("ax.set_title('t', fontweight='light')", {("T2", None)}),
        "lone bars": ("ax.bar(x)\nax.set_title('t')\nax.set_xlabel('')\nax.set_ylabel('')", {("E4", None)}),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in scripts.items()], "path string, text string")
    got = {}
    for r in lint.lint(df).collect():
        got.setdefault(r.path, set()).add((r.rule, r.line))
    assert got == {k: v[1] for k, v in scripts.items() if v[1]}
    assert lint.colormap_for("diverging") == "RdBu_r" and len(lint.categorical_colors(6)) == 6
    import pytest

    with pytest.raises(ValueError):
        lint.categorical_colors(7)


def test_least_squares(spark):
    """Paired designs against numpy: the treatment's effect and t with a term for each sample, for all features at once."""
    import numpy as np

    from corvellum.operators import compare

    rng = np.random.default_rng(0)
    units = [(f"s{s}{c}", f"s{s}", c) for s in range(4) for c in (0, 1)]
    y = {(u, f): float(rng.normal() + int(u[1]) + (8 if f == "f0" and c else 0)) for u, _, c in units for f in ("f0", "f1", "f2", "f3", "f4")}
    frame = spark.createDataFrame(units, "unit string, sample string, treated int")
    long = spark.createDataFrame([(*k, v) for k, v in y.items()], "unit string, feature string, value double")
    for paired in (True, False):
        design = apply(compare.design_matrix(paired), units=frame)
        got = {r.feature: r for r in compare.least_squares(long, design).collect()}
        x = np.array([[1, c, *[int(paired and s == f"s{k}") for k in range(1, 4)]] for _, s, c in units], float)
        for f in ("f0", "f1", "f2", "f3", "f4"):
            v = np.array([y[u, f] for u, *_ in units])
            b, *_ = np.linalg.lstsq(x, v, rcond=None)
            df = len(v) - np.linalg.matrix_rank(x)
            se = np.sqrt(((v - x @ b) ** 2).sum() / df * np.linalg.pinv(x.T @ x)[1, 1])
            assert got[f].df == df and abs(got[f].effect - b[1]) < 1e-9 and abs(got[f].t_stat - b[1] / se) < 1e-6
        assert got["f0"].t_stat > 5


def test_intervals_against_reported_p(spark):
    from corvellum.operators import records

    rows = [(1, 1.0, 0.0, 2.0, False, 0.05), (2, 1.0, 0.0, 2.0, False, 0.2), (3, 2.0, 1.0, 4.0, True, 0.05), (4, 1.0, 1.0, 1.0, False, 0.05), (5, None, 0.0, 2.0, False, 0.05), (6, 1.0, 0.0, 2.0, False, None)]
    got = {r.id: (r.p_from_interval and round(r.p_from_interval, 4), r.agrees) for r in records.interval_agrees(spark.createDataFrame(rows, "id int, estimate double, low double, high double, ratio boolean, p_reported double")).collect()}
    assert got == {1: (0.05, True), 2: (0.05, False), 3: (0.05, True), 4: (None, None), 5: (None, None), 6: (0.05, None)}


def test_samples_alike_block_by_block(spark, monkeypatch):
    from corvellum.operators import alike, inference

    monkeypatch.setattr(alike, "MOST", 16)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(90, 6)) + 100
    base[50:60] = base[:10] * 2 + 1e-3 * rng.normal(size=(10, 6))
    base[60:64] = 7.25  # no variance
    rows = [(f"s{i}", f"f{c}", None if (i + c) % 23 == 0 else float(v)) for i, r in enumerate(base) for c, v in enumerate(r) if (i * 7 + c) % 5]
    long = spark.createDataFrame(rows, "sample string, feature string, value double")
    got = {(r.a, r.b): (r.shared, r.r) for r in alike.near_duplicates(long, 3, 0.8).collect()}
    assert got == {(r.a, r.b): (r.shared, r.r) for r in apply(inference.near_duplicate_columns(3, 0.8), long=long).collect()} and len(got) > 10
    assert alike.near_duplicates(long.where("sample = ''"), 3, 0.8).count() == 0


def test_a_text_is_parsed_once(spark):
    from corvellum.operators import lint

    parsed = spark.sparkContext.accumulator(0)
    real = lint.facts

    def counted(text):
        parsed.add(1)
        return real(text)

    lint.facts = counted
    try:
        df = spark.range(200).select(F.col("id").cast("string").alias("path"), F.when(F.col("id") % 4 == 0, "ax.pie(x)").when(F.col("id") % 4 == 1, "x = 1").when(F.col("id") % 4 == 2, "").alias("text"))
        assert {r.path for r in lint.lint(df).where("rule = 'H1b'").collect()} == {str(i) for i in range(0, 200, 4)}
    finally:
        lint.facts = real
    assert parsed.value <= 3
