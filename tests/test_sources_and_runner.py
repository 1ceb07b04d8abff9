"""Readers on small files, distribution tails, the stage runner and reports."""

import gzip
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvellum.functions import dist
from corvellum.operators import learn, sampling, structure
from corvellum.plans import report
from corvellum.plans.sqlplan import apply
from corvellum.plans.runner import StageFailed, StageRunner
from corvellum.sources import text


def test_tails():
    three = 1 - 2 / math.pi * (math.atan(12 / math.sqrt(3)) + 12 * math.sqrt(3) / (12 * 12 + 3))  # closed form for 3 degrees of freedom
    assert np.allclose(dist.t_two_sided([2.0, 0.0, 12.0], [10, 4, 3]), [0.0733880, 1.0, three], atol=1e-6)
    assert np.allclose(dist.chi2_upper([3.841459, 9.487729, 0.0], [1, 4, 2]), [0.05, 0.05, 1.0], atol=1e-6)
    assert np.allclose(dist.f_upper([4.102821], [2], [10]), [0.05], atol=1e-6)
    assert np.allclose(dist.binomial_upper([8, 0], [10, 10]), [56 / 1024, 1.0])
    assert np.allclose(dist.normal_two_sided([1.959964]), [0.05], atol=1e-6)
    df = 7
    x = np.linspace(-60, 60, 400_001)
    density = math.gamma((df + 1) / 2) / (math.sqrt(df * math.pi) * math.gamma(df / 2)) * (1 + x * x / df) ** (-(df + 1) / 2)
    outside = 1 - np.trapezoid(density[np.abs(x) <= 1.5], x[np.abs(x) <= 1.5])
    assert abs(dist.t_two_sided([1.5], [df])[0] - outside) < 1e-4


def test_wide_matrix(spark, tmp_path):
    path = str(tmp_path / "m.txt.gz")
    with gzip.open(path, "wt") as f:
        f.write("\tc1\tc2\tc3\n\tP1\tP1\tP2\ng1\t1\t0\t2\t\ng2\t0\t0\t5\t\ng3\t1\t2\ng4\tx\t1\t1\n")
    expr, units, bad = text.wide_matrix(spark, path, label_row=True)
    assert {tuple(r) for r in expr.collect()} == {("c1", "g1", 1.0), ("c3", "g1", 2.0), ("c3", "g2", 5.0)}
    assert {tuple(r) for r in units.collect()} == {("c1", "P1"), ("c2", "P1"), ("c3", "P2")} and bad == 2
    assert text.gzip_reads(path)
    whole = open(path, "rb").read()
    open(path, "wb").write(whole[:-10])
    assert not text.gzip_reads(path)


def test_other_files(spark, tmp_path):
    mtx = tmp_path / "a.mtx"
    mtx.write_text("%%MatrixMarket matrix coordinate integer general\n%\n3 2 3\n1 1 5\n3 1 1\n2 2 7\n")
    got = {tuple(r) for r in text.matrix_market(spark, str(mtx), ["g1", "g2", "g3"], ["u1", "u2"]).collect()}
    assert got == {("u1", "g1", 5.0), ("u1", "g3", 1.0), ("u2", "g2", 7.0)}
    with pytest.raises(ValueError):
        text.matrix_market(spark, str(mtx), ["g1"], ["u1"])
    gmt = tmp_path / "s.gmt"
    gmt.write_text("# header\nsetA\tdesc\tg1\tG2\tg3\n\nshort\tx\n")
    assert {tuple(r) for r in text.gene_sets(spark, str(gmt)).collect()} == {("setA", "G1"), ("setA", "G2"), ("setA", "G3")}
    csv = tmp_path / "c.csv"
    csv.write_text("barcode,kind,g1,g2\nb1,x,1,0\nb2,y,0,3\n")
    expr, obs = text.cells_csv(spark, [str(csv)], "barcode", "kind")
    assert {tuple(r) for r in expr.collect()} == {("b1", "g1", 1.0), ("b2", "g2", 3.0)} and obs.count() == 2
    sheet = tmp_path / "s.txt"
    sheet.write_text("# a\n# b\nSample name\ttitle\tcharacteristics: patient\nSample 1\tc1\tP1\nSample 2\tc2\tP2\nother\n")
    rows = text.sample_sheet(spark, str(sheet), "Sample name", "Sample", {"id": "title", "patient": "patient"}).collect()
    assert [tuple(r) for r in rows] == [("c1", "P1"), ("c2", "P2")]
    panel = text.marker_panel(spark.createDataFrame([("T1", "G1; G2", "G9")], "cell_type string, positive string, negative string"))
    assert {(r.gene, r.sign) for r in panel.collect()} == {("G1", "+"), ("G2", "+"), ("G9", "-")}
    guide = spark.createDataFrame([("A", "h1", "Homo", True, 0.0), ("A", "h2", "Homo", False, 2.0), ("A", "m1", "Mus", False, 9.0), ("A", "RPL3", "Homo", False, 5.0)], "cell_type string, symbol string, organism string, canonical boolean, score double")
    assert text.panel_from_guide(guide, "Homo").first().positive == "H1;H2"
    r = tmp_path / "r"
    r.mkdir()
    (r / "a.json").write_text(json.dumps({"checks": [{"check": "x", "status": "WARN", "detail": "d"}, {"check": "y", "status": "PASS", "detail": ""}], "not_run": ["z"]}))
    (r / "own.json").write_text(json.dumps({"checks": [{"check": "q", "status": "FAIL", "detail": "d"}], "not_run": []}))
    assert {(c.check, c.status) for c in text.caveats(spark, str(r), "own").collect()} == {("x", "WARN"), ("z", "NOT RUN")}
    assert text.file_integrity(spark, str(gmt)).first().sha256 == text.file_hash(str(gmt))


def _stage(spark, name, calls, status="PASS", rows=None):
    def fn(previous, own, everyone):
        calls.append(name)
        return {"t": spark.range(rows or own.get("k", 3)).toDF("id")}, [report.record("c", status, "what", "found", "why")]

    return fn


def test_runner(spark, tmp_path):
    calls = []
    names, folder = ["a", "b", "c"], str(tmp_path / "run")
    run = StageRunner(spark, folder, names, {"global": {"species": "x"}, "stage": {"b": {"k": 1}}})
    with pytest.raises(StageFailed, match="b needs a, which is not_run"):
        run.run("b", _stage(spark, "b", calls))
    run.run("a", _stage(spark, "a", calls))
    run.run("a", _stage(spark, "a", calls))
    assert calls == ["a"] and run.run("b", _stage(spark, "b", calls))["t"].count() == 1
    other = StageRunner(spark, folder, names, {"global": {"species": "x"}, "stage": {"b": {"k": 2}}})
    assert other.state("a") == ("current", "") and other.state("b") == ("stale", "its parameters have changed") and other.state("c")[0] == "not_run"
    with pytest.raises(StageFailed):
        run.run("c", _stage(spark, "c", calls, "FAIL"))
    assert run.state("c")[0] == "failed" and run.load("c")["t"].count() == 3
    with pytest.raises(ValueError):
        run.accept("c", " ")
    run.accept("c", "known")
    assert run.state("c")[0] == "current"
    assert run.telemetry().where("seconds > 0 AND driver_mb > 0 AND versions LIKE '%pyspark%'").count() == 3
    assert "Overall: PASS" in (tmp_path / "run/reports/00_a.md").read_text()


def test_runner_goes_by_content(spark, tmp_path):
    calls = []
    run = StageRunner(spark, str(tmp_path), ["a", "b"], {})
    run.run("a", _stage(spark, "a", calls))
    run.run("b", _stage(spark, "b", calls))
    run.run("a", _stage(spark, "a", calls), force=True)
    assert run.state("b") == ("current", "")  # made again, with the same rows
    run.run("a", _stage(spark, "a", calls, rows=5), force=True)
    assert run.state("a")[0] == "current" and run.state("b") == ("stale", "its input has changed")
    run.run("b", _stage(spark, "b", calls))
    output = run._runs()["a"]["output"]
    spark.range(4).toDF("id").write.mode("overwrite").parquet(f"{output}/t")
    assert run.state("a") == ("stale", "its output has changed") and run.state("b") == ("stale", "a is stale")
    run.run("a", _stage(spark, "a", calls, rows=5))
    run.run("b", _stage(spark, "b", calls))
    kept = run._runs()["b"]["output"]
    run.invalidate("b")
    import os

    assert run.status() == {"a": ("current", ""), "b": ("not_run", "never run")} and not os.path.exists(kept)
    assert [r.kind for r in run.events().orderBy("at").collect()][-1] == "forgotten"


def test_reports(spark):
    ok, warn, fail, info = (report.record(f"c{i}", s, "w", "f", "y") for i, s in enumerate(("PASS", "WARN", "FAIL", "INFO")))
    assert report.rating([ok]) == "Good" and report.rating([ok, warn]) == "Usable, with 1 caveat" and report.rating([info]) == "Not applicable"
    assert report.rating([fail]) == "Not reliable until fixed" and report.rating([fail], "known") == "Accepted despite a failed check" and report.rating([]) == "Not done"
    assert report.overall([]) == "PASS" and report.overall([ok, info]) == "PASS" and report.overall([ok, warn]) == "WARN" and report.overall([warn, fail]) == "FAIL"
    assert report.run_rating(["Good", "Usable, with 1 caveat", "Not done"]) == "Not done"
    text = report.card("t", [ok] * 6 + [warn, fail])
    assert "1 more not shown" in text and text.index("FAIL") < text.index("WARN") < text.index("PASS")
    assert report.not_run([ok, dict(info, group="g")], {"c0": "x", "g": "y", "z": "w"}) == ["z"]
    summary = report.run_summary([{"name": "one", "records": [ok]}, {"name": "two", "records": [fail], "accepted": "known", "note": "n", "go_back": "one"}])
    assert "Run: Accepted despite a failed check" in summary and "| two | Accepted despite a failed check | n | one |" in summary
    with pytest.raises(ValueError):
        report.record("c", "MAYBE", "w", "f", "y")


def test_structure_helpers(spark):
    frame = lambda eig, null: spark.createDataFrame([(i + 1, float(e), float(z), r) for i, (e, z, r) in enumerate(zip(eig, null, (0.4, 0.3, 0.1, 0.05, 0.02), strict=True))], "pc int, eig double, null_max double, ratio double")
    some = frame([10, 5, 2, 1, 0.5], [0.6] * 5)
    choice = lambda t, basis, eig=some: tuple(apply(structure.component_choice(t, basis), eig=eig).first())[:2]
    assert [choice(t, "signal") for t in (0.5, 0.9, 0.99)] == [(1, True), (3, True), (4, True)]
    assert [choice(t, "total") for t in (0.5, 0.75, 0.85, 0.99)] == [(2, True), (3, True), (4, True), (5, False)]
    assert choice(0.9, "signal", frame([10, 5, 2, 1, 0.5], [11, 6, 3, 2, 1])) == (0, True)
    assert choice(0.99, "signal", frame([10, 5, 0.5, 0.5, 3], [0.6] * 5))[0] == 2  # a component above the null after one below doesn't count
    assert apply(structure.component_choice(), eig=some).first().elbow == 3
    scan = spark.createDataFrame([(0.1, 2, 0.99, 50, True), (0.5, 4, 0.9, 20, True), (1.0, 9, 0.6, 5, True)], "resolution double, n_clusters int, stability double, min_size int, distinct boolean")
    assert structure.picked_resolution(scan) == 0.5 and structure.picked_resolution(scan.where("resolution <> 0.5"), 0.999) == 0.1
    assert learn.matched_label("CD4 T cells", ["T cells", "B"]) == "T cells"
    rng = np.random.default_rng(0)
    rows = [(g * 20 + i, [float(x) for x in rng.normal(size=6) * 0.1 + np.eye(6)[g] * 5]) for g in range(3) for i in range(20)]
    vec = spark.createDataFrame(rows, "id long, v array<double>")
    got = {r.id: r.cluster for r in structure.communities(structure.shared_neighbour_graph(structure.nearest(vec, 6)), resolution=0.3, rounds=12).collect()}
    assert all(len({got[g * 20 + i] for i in range(20)} & {got[h * 20 + i] for i in range(20)}) == 0 for g in range(3) for h in range(g))



def test_graphs_search_their_neighbours_once(spark):
    """Rows that leave the search are counted: 200 units with 3 neighbours each, through either graph."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for frame in batches:
            seen.add(len(frame))
            yield frame

    vec = spark.createDataFrame([(i, [float(i % 17), float(i % 23), float(i % 5)]) for i in range(200)], "id long, v array<double>")
    plain = structure.nearest(vec, 3).collect()
    near = structure.nearest(vec, 3).mapInPandas(count, "id long, other long, distance double, place int")
    graph = {(r.src, r.dst): r.weight for r in structure.kept(structure.shared_neighbour_graph(near)).collect()}
    assert seen.value == 600
    sets = {i: {r.other for r in plain if r.id == i} for i in range(200)}
    want = {p: max(len(sets[r.id] & sets[r.other]), 1) / len(sets[r.id] | sets[r.other]) for r in plain for p in ((r.id, r.other), (r.other, r.id))}
    assert graph == want
    pieces = structure.graph_components(structure.both_ways(near.select(F.col("id").alias("src"), F.col("other").alias("dst"))), vec.select("id")).collect()
    assert seen.value == 1200 and len(pieces) == 200


def test_samples(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 AS g")
    assert {r.half for r in sampling.halves(df, "id").collect()} == {0, 1}
    assert sampling.capped(df, "id", 10).count() == 10
    assert {r["count"] for r in sampling.capped_per_group(df, "g", "id", 7).groupBy("g").count().collect()} == {7}
    assert sampling.stratified(df, ["g"], "id", 0.001).count() == 3
    shifted = spark.range(200).selectExpr("id", "id % 2 AS grp", "(id % 2) * 3.0 + id % 7 AS value")
    assert sampling.permutation_difference(shifted, 200).first().p < 0.02


def test_shuffles_keep_columns_and_break_links(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 1))
    x = np.hstack([base + 0.1 * rng.normal(size=(400, 3)), rng.normal(size=(400, 2)) * 2])
    vec = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")
    null = structure.shuffled_variances(vec, 5, 5, runs=3)
    value = structure.principal_components(vec, 5, 5)[1]
    assert value[0] < 4.8 and abs(null.sum() - x.var(0, ddof=1).sum()) < 0.5  # variances stay, their links go
    strong = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(np.hstack([base * 2 + 0.1 * rng.normal(size=(400, 5))]))], "id long, v array<double>")
    assert (structure.principal_components(strong, 5, 5)[1] > structure.shuffled_variances(strong, 5, 5, runs=3)).tolist() == [True, False, False, False, False]


def test_components_of_tasks_without_rows(spark):
    rng = np.random.default_rng(4)
    vec = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(50, 3)))], "id long, v array<double>")
    scores, value, _ = structure.principal_components(vec.repartition(8, F.lit(1)), 3, 2)  # one task has all rows
    whole, want, _ = structure.principal_components(vec, 3, 2)
    assert np.allclose(value, want) and scores.count() == 50 and want[0] > 0
    assert all(np.allclose(a.scores, b.scores) for a, b in zip(scores.orderBy("id").collect(), whole.orderBy("id").collect(), strict=True))
    assert structure.principal_components(vec.where("id < 0"), 3, 2)[1].tolist() == [0, 0]


def test_neighbours_among_copies_and_in_blocks(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 5)) + 1000
    x[rng.permutation(400)[:60]] = x[0]  # copies, whose ties go by id
    ids = rng.permutation(400)
    rows = [(int(i), [float(v) for v in r], int(i) % 3) for i, r in zip(ids, x, strict=True)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label long")
    place = np.argsort(ids)
    d = np.sqrt(((x[place][:, None] - x[place][None]) ** 2).sum(2))
    far = d + np.where(np.eye(400, dtype=bool), np.inf, 0)
    want = {i: np.lexsort((np.arange(400), far[i]))[:7].tolist() for i in range(400)}
    for block in (16, 64, 2048):
        got = {i: [None] * 7 for i in range(400)}
        for r in structure.nearest(df.select("id", "v"), 7, block).collect():
            got[r.id][r.place - 1] = r.other
            assert r.distance == d[r.id, r.other]
        assert got == want
    own = np.arange(400) % 3
    m = np.stack([d[:, own == c].sum(1) / ((own == c).sum() - (own == c)) for c in range(3)])
    a = m[own, np.arange(400)]
    b = np.where(np.arange(3)[:, None] == own, np.inf, m).min(0)
    sil = {r.id: r.silhouette for r in structure.silhouette(df.select("id", "v"), df.select("id", "label"), 64).collect()}
    assert np.allclose([sil[i] for i in range(400)], (b - a) / np.maximum(a, b), atol=1e-9)


def test_neighbours_move_no_row_for_each_pair_of_blocks(spark):
    vec = spark.range(1000).select("id", F.array(F.rand(1), F.rand(2)).alias("v"))
    found = structure.nearest(vec, 3, 10)  # about 100 blocks
    assert found.count() == 3000
    assert structure._cartesian(structure._blocks(vec, 10)[0], 100).rdd.getNumPartitions() <= 100 * 4


def test_programs_that_restarts_agree_on(spark):
    rng = np.random.default_rng(5)
    planted = np.zeros((2, 12))
    planted[0, :4], planted[1, 6:10] = 3, 3
    rows = rng.gamma(0.5, size=(300, 2)) @ planted + 0.01 * rng.random((300, 12))
    vec = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "id long, v array<double>")
    k, agreed, table, h = structure.stable_programs(vec, 12, ks=(2,), restarts=2, rounds=40)
    assert (k, agreed, h.shape) == (2, True, (2, 12)) and table[0][1] > 0.95
    assert {frozenset(np.argsort(-row)[:4].tolist()) for row in h} == {frozenset(range(4)), frozenset(range(6, 10))}


def test_expectations_references_and_guides(spark, tmp_path):
    table = tmp_path / "e.csv"
    table.write_text("expectation,kind,column,group,genes,set,direction,low\nup,gene_up,cluster,1,G1; g2,,,\nshare,fraction_range,cluster,2,,,,0.25\nset,set_enriched,cluster,1,,wnt,up,\n")
    rules, wanted = text.expectations(spark, str(table))
    assert [(r.expectation, r.kind, r.col, r.grp, r.against, r.direction, r.low, r.high) for r in rules.collect()] == [("up", "gene_up", "cluster", "1", "", "up", None, None), ("share", "fraction_range", "cluster", "2", "", "up", 0.25, None), ("set", "set_enriched", "cluster", "1", "", "up", None, None)]
    assert sorted((r.expectation, r.feature_id.upper()) for r in wanted.collect()) == [("set", "WNT"), ("up", "G1"), ("up", "G2")]
    (tmp_path / "bad.csv").write_text("expectation,kind\na,b\n")
    with pytest.raises(ValueError):
        text.expectations(spark, str(tmp_path / "bad.csv"))
    spark.createDataFrame([("c1", "G1", 1.0), ("c2", "G1", 2.0), ("c3", "G1", 3.0)], "unit_id string, feature_id string, value double").write.parquet(str(tmp_path / "ref"))
    (tmp_path / "l.csv").write_text("cell,type\nc1,T\nc2,B\nc3,\n")
    assert {(r.unit_id, r.label) for r in text.labelled_reference(spark, str(tmp_path / "ref"), str(tmp_path / "l.csv"), "type", "cell").collect()} == {("c1", "T"), ("c2", "B")}
    with pytest.raises(ValueError):
        text.labelled_reference(spark, str(tmp_path / "ref"), str(tmp_path / "l.csv"), "kind", "cell")
    (tmp_path / "g.json").write_text(json.dumps({"A": {"id": "1", "canonical": ["h1"], "computational": [{"symbol": "h2", "organism": "Homo", "marker_score": 2.0}, {"symbol": "RPL3", "organism": "Homo", "marker_score": 5.0}, {"symbol": "m1", "organism": "Mus", "marker_score": 9.0}]}}))
    assert text.panel_from_guide(text.guide_rows(spark, str(tmp_path / "g.json")), "Homo").first().positive == "H1;H2"
    want = spark.createDataFrame([("l.csv", 24, None), ("e.csv", 1, "00"), ("gone", 1, None)], "name string, bytes long, sha256 string")
    got = {r.path.split("/")[-1]: (r.size_status, r.hash_status) for r in text.file_integrity(spark, str(tmp_path / "*.csv"), want).collect()}
    assert got == {"l.csv": ("PASS" if (tmp_path / "l.csv").stat().st_size == 24 else "FAIL", "INFO"), "e.csv": ("FAIL", "FAIL"), "bad.csv": ("INFO", "INFO"), "gone": ("FAIL", "FAIL")}


def test_permutations_keep_group_sizes(spark):
    rows = [(i, int(i < 7), float(i * i % 11)) for i in range(20)] + [(99, 1, None), (98, None, 3.0)]
    got = sampling.permutation_difference(spark.createDataFrame(rows, "id long, grp int, value double"), 400, 3).first()
    x = np.array([r[2] for r in rows[:20]])
    d = x[:7].mean() - x[7:].mean()
    rng = np.random.default_rng(0)
    null = np.array([p[:7].mean() - p[7:].mean() for p in (rng.permutation(x) for _ in range(20000))])
    assert abs(got.difference - d) < 1e-12 and abs(got.p - (np.abs(null) >= abs(d) - 1e-12).mean()) < 0.08


def test_permutations_are_those_of_all_hashes(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("id", "CAST(id % 5 = 0 AS INT) AS grp", "CAST(id * id % 101 + CAST(id % 5 = 0 AS INT) * 2 AS DOUBLE) AS value").withColumn("id", F.when(F.col("id") % 50 == 0, 0).otherwise(F.col("id")))
    own = rows.where("id > 0")  # ids that repeat would leave ties open
    h = own.crossJoin(spark.range(40).withColumnRenamed("id", "perm")).select("perm", "id", "value", F.xxhash64(F.lit(0), "perm", "id").cast("double").alias("h")).toPandas()
    n1, x = own.agg(F.sum("grp")).first()[0], own.toPandas()
    d = x.value[x.grp == 1].mean() - x.value[x.grp == 0].mean()
    null = [p.value[:n1].mean() - p.value[n1:].mean() for _, p in h.sort_values(["h", "id"]).groupby("perm")]
    want = (np.sum(np.abs(null) >= abs(d) - 1e-12) + 1) / 41
    for off in (8.0, 0.0):  # with no allowance the permutations are ranked whole
        monkeypatch.setattr(sampling, "OFF", off)
        got = sampling.permutation_difference(own, 40).first()
        assert abs(got.difference - d) < 1e-9 and abs(got.p - want) < 1e-12
    monkeypatch.undo()
    assert 0 < sampling.permutation_difference(rows, 20).first().p <= 1  # 60 rows of one hash
