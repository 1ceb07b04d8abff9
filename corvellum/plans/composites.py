"""Whole stages put together from the operators, as functions for `StageRunner` or for use alone, and the general worked
example on synthetic data with planted effects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvellum.functions.dist import t_p, z_p
from corvellum.operators import alike, compare, designs, enrich, glm, inference, learn, matrix, prose_checks, sampling, structure, variable
from corvellum.plans.catalogues import CATALOGUES
from corvellum.plans.report import card, record, run_summary
from corvellum.plans.sqlplan import apply


def qc_stage(expr: DataFrame, obs: DataFrame, special: str, min_features: int, max_features: int, max_pct: float, min_units: int) -> tuple[dict[str, DataFrame], list[dict]]:
    """Metrics, signal check, masks, their impact, and the matrix that is left."""
    metrics = apply(matrix.qc_metrics(special), expr=expr)
    signal = apply(matrix.signal_present(), metrics=metrics).first()
    masks = apply(matrix.fail_masks(min_features, max_features, max_pct), metrics=metrics)
    kept = expr.join(masks.where("keep").select("unit_id"), "unit_id", "left_semi")
    seen = apply(matrix.seen_features(min_units), expr=kept)
    out = kept.join(seen.select("feature_id"), "feature_id", "left_semi").select("unit_id", "feature_id", "value")
    impact = {r.what: r.removed for r in apply(matrix.filter_impact(), masks=masks, obs=obs).collect()}
    total = metrics.count()
    share = impact["any"] / max(total, 1)
    return {"expr": out, "metrics": metrics, "masks": masks}, [
        record("special signal", signal.status, "share of units with special features", f"{signal.share}", "a panel that is never seen tests nothing"),
        record("removal", "FAIL" if share > 0.5 else "WARN" if share > 0.2 else "PASS", "share of units removed", f"{share:.3f}", "a filter that removes most units describes the filter"),
    ]


#: What undoes the log of a scale.
_LINEAR = {"linear_tpm": "value", "log2tpm": "power(2, value) - 1", "log1p_cp10k": "exp(value) - 1"}


def _most_variable(expr: DataFrame, obs: DataFrame, scale: str, n_top: int) -> DataFrame:
    """feature_id and more of the most variable features: of counts by their trend, of other scales by dispersion of linear values."""
    if scale == "counts":
        return variable.variable_counts(expr.select("unit_id", "feature_id", "value"), obs.select("unit_id", F.lit("all").alias("batch")), n_top)
    n = obs.select("unit_id").distinct().count()
    linear = expr.join(obs.select("unit_id"), "unit_id", "left_semi").select("unit_id", "feature_id", F.expr(_LINEAR[scale]).alias("value"))
    return apply(matrix.variable_features(f"CAST({n} AS DOUBLE)", top=n_top), expr=linear)


def features_stage(expr: DataFrame, obs: DataFrame, n_top: int) -> tuple[dict[str, DataFrame], list[dict]]:
    """Scale, normalisation, its checks, and the most variable features: of counts as they are, of other scales with the log undone."""
    scale = apply(matrix.detect_scale(), expr=expr).first().scale
    if scale == "scaled_or_unknown":
        return {}, [record("scale", "FAIL", "scale of the values", scale, "values on an unknown scale can't be normalised")]
    logs = apply(matrix.normalise(scale), expr=expr)
    checks = apply(matrix.normalisation_checks(), sums=apply(matrix.linear_sums(scale), expr=expr), obs=obs).first()
    n = obs.select("unit_id").distinct().count()
    top = _most_variable(expr, obs, scale, n_top).persist()
    selected = top.select("feature_id")
    units = obs.withColumn("half", F.pmod(F.xxhash64("unit_id"), F.lit(2)))
    halves = [_most_variable(expr, units.where(F.col("half") == h), scale, n_top).select("feature_id") for h in (0, 1)]
    stats = logs.groupBy("feature_id").agg((F.sum("value") / n).alias("mean"), (F.count(F.when(F.col("value") > 0, 1)) / n).alias("detected"))
    more, batches, inputs = {}, 0, {"selected": selected, "stats": stats, "half_a": halves[0], "half_b": halves[1]}
    if "batch" in obs.columns:
        names = [r.batch for r in obs.select("batch").distinct().orderBy("batch").collect()]
        batches = len(names)
        if scale == "counts":
            found = variable.standardised_variance(expr.select("unit_id", "feature_id", "value"), obs.select("unit_id", "batch"))
            every = found.withColumn("i", F.row_number().over(Window.partitionBy("batch").orderBy(F.desc(F.round("score", 9)), "feature_id"))).where(F.col("i") <= n_top)
        else:
            every = reduce(DataFrame.union, [_most_variable(expr, obs.where(F.col("batch") == b), scale, n_top).select("feature_id") for b in names])
        more = {"batches": every.groupBy("feature_id").agg(F.count("*").alias("n"))}
    chosen = apply(matrix.selection_checks(n_top, batches), **inputs, **more).collect()
    return {"expr": logs, "variable": top}, [
        record("scale", "INFO", "scale of the values", scale, "it decides how values are normalised", "method matches scale"),
        record("depth", checks.depth_status, "largest over smallest sample depth", f"{checks.depth_ratio}", "unequal depth can pass for biology", "depth spread across samples"),
        *[record(r.check_name, r.status, CATALOGUES["features"][r.check_name], f"{r.figure}", "groups are found on these features only") for r in chosen],
    ]


def _differences(expr: DataFrame, clusters: DataFrame, pairs: DataFrame, padj: float) -> DataFrame:
    """`compare.group_differences` of clusters, with BH within each pair."""
    obs = clusters.select("unit_id", F.col("cluster").cast("string").alias("grp"))
    d = apply(compare.group_differences(), expr=expr, obs=obs, pairs=pairs).withColumn("p", z_p(F.col("z"))).withColumn("pair", F.concat_ws(" ", "a", "b")).withColumn("id", F.concat_ws("\u0001", "pair", "feature_id")).persist()
    q = apply(inference.multiplicity("pair", padj), p=d.select("id", "pair", "p")).select("id", "bh", "bh_called")
    return d.join(q, "id").select("a", "b", "feature_id", "z", "log2fc", "seen", "bh", "bh_called")


def cluster_stage(
    vec: DataFrame, batches: DataFrame | None = None, expr: DataFrame | None = None, k: int = 15, resolutions: tuple[float, ...] = (0.1, 0.2, 0.3, 0.5, 0.8, 1.0, 1.5, 2.0), boots: int = 5, share: float = 0.8, rounds: int = 8,
    min_stability: float = 0.8, min_cells: int = 10, min_share: float = 0.005, max_share: float = 0.5, min_jaccard: float = 0.6, min_markers: int = 5, log2fc: float = 0.5, padj: float = 0.01, min_seen: float = 0.25, min_pair: int = 10,
) -> tuple[dict[str, DataFrame], list[dict]]:
    """Communities at several resolutions, their stability under resamples of the units, the finest one that is stable and
    whose neighbouring clusters differ, and what makes its clusters. ``vec`` is (id, unit_id, v); ``expr`` has the selected
    features' log values for markers, ``batches`` (id, batch). Graphs of resamples are made once for all resolutions.
    """
    spark, what = vec.sparkSession, CATALOGUES["cluster"]
    note = lambda check, status, found, why: record(check, status, what[check], found, why)
    n = vec.count()
    smallest = max(min_cells, -(-n * min_share // 1))
    points, names = vec.select("id", "v"), vec.select("id", "unit_id")
    label = lambda edges, r, seed: structure.kept(structure.communities(edges, r, rounds, seed))
    graph = structure.kept(structure.shared_neighbour_graph(structure.nearest(points, k)))
    whole = {r: label(graph, r, 0) for r in resolutions}
    agree: dict[float, list[float]] = {r: [] for r in resolutions}
    found = {r: spark.createDataFrame([], "cluster string, jaccard double") for r in resolutions}
    for b in range(boots):
        part = points.where(F.pmod(F.xxhash64(F.lit(b), "id"), F.lit(1000)) < int(1000 * share))
        sub = structure.kept(structure.shared_neighbour_graph(structure.nearest(part, k)))
        for r in resolutions:
            both = whole[r].select("id", F.col("cluster").alias("a")).join(label(sub, r, b + 1).select("id", F.col("cluster").alias("b")), "id").persist()
            agree[r].append(apply(inference.adjusted_rand(), labels=both).first().ari or 0.0)
            found[r] = found[r].union(apply(inference.best_jaccard(), labels=both).select("a", "jaccard"))
    median = lambda xs: float(sorted(xs)[len(xs) // 2] if len(xs) % 2 else sum(sorted(xs)[len(xs) // 2 - 1 : len(xs) // 2 + 1]) / 2) if xs else 0.0
    rows, distinct = [], {}
    for r in resolutions:
        size = whole[r].groupBy("cluster").count().agg(F.count("*").alias("n"), F.min("count").alias("least"), F.max("count").alias("most")).first()
        sil = structure.silhouette(points, whole[r].select("id", F.col("cluster").alias("label"))).agg(F.avg("silhouette")).first()[0] if size.n > 1 else None
        rows.append([float(r), int(size.n), median(agree[r]), float(min(agree[r], default=0.0)), int(size.least), float(size.most / n), sil])
    named = {r: whole[r].join(names, "id") for r in resolutions}
    between = lambda r: structure.nearest_centroids(points, whole[r].select("id", F.col("cluster").alias("label")))

    def separating(r: float) -> dict[tuple[str, str], int]:
        d = _differences(expr, named[r], between(r), padj).where((F.abs("log2fc") >= log2fc) & F.col("bh_called"))
        got = {(x.a, x.b): x["count"] for x in d.groupBy("a", "b").count().collect()}
        return {(x.a, x.b): got.get((x.a, x.b), 0) for x in between(r).collect()}

    close: dict[float, dict] = {}
    for r, k_, stable, _, least, *_ in sorted(rows, reverse=True):
        if expr is not None and k_ >= 2 and stable >= min_stability and least >= smallest:
            close[r] = separating(r)
            distinct[r] = min(close[r].values(), default=min_pair) >= min_pair
            if distinct[r]:
                break
    scan = spark.createDataFrame([(*x, distinct.get(x[0])) for x in rows], "resolution double, n_clusters int, stability double, stability_min double, min_size int, max_share double, silhouette double, distinct boolean")
    pick = structure.picked_resolution(scan, min_stability, smallest)
    pick = pick if pick is not None else resolutions[0]
    _, n_clusters, stable, worst, least, most, _ = next(x for x in rows if x[0] == pick)
    good = n_clusters >= 2 and stable >= min_stability and least >= smallest and distinct.get(pick) is not False
    weak = found[pick].groupBy("cluster").agg(F.avg("jaccard").alias("j")).where(F.col("j") < min_jaccard).count()
    limit = max(2, min(60, n // 20))
    notes = [
        note("representation used", "INFO", f"{n} units, {k} neighbours", "clusters are groups in these components"),
        note("resolution chosen from the data", "INFO" if good else "WARN", f"{pick}: {n_clusters} clusters", "clusters that come and go are not groups"),
        note("chosen resolution is stable", "PASS" if stable >= min_stability else "WARN", f"agreement {stable:.2f}, at worst {worst:.2f}, over {boots} resamples", "other units would give other clusters"),
        note("cluster count", "PASS" if 2 <= n_clusters <= limit else "WARN", f"{n_clusters}, plausible 2 to {limit}", "very many or one mean nothing"),
        note("no tiny clusters", "PASS" if least >= smallest else "WARN", f"smallest has {least}, limit {smallest:.0f}", "a few cells can't be told from chance"),
        note("no dominant cluster", "PASS" if most <= max_share else "WARN", f"largest holds {most:.2f}", "it may hide groups"),
        note("per-cluster stability", "WARN" if weak else "PASS", f"{weak} clusters recovered under {min_jaccard}", "they may be artefacts"),
    ]
    out = {"scan": scan, "clusters": named[pick].select("id", "unit_id", "cluster")}
    if expr is not None and n_clusters >= 2:
        few = {p: c for p, c in (close[pick] if pick in close else separating(pick)).items() if c < min_pair}
        notes.append(note("neighboring clusters distinguishable", "WARN" if few else "PASS", f"{len(few)} pairs with under {min_pair} genes between them", "they may be one"))
        everyone = out["clusters"].select(F.col("cluster").alias("a")).distinct().withColumn("b", F.lit(None).cast("string"))
        d = _differences(expr, out["clusters"], everyone, padj)
        out["markers"] = d.where((F.col("log2fc") >= log2fc) & F.col("bh_called") & (F.col("seen") >= min_seen) & (F.col("z") > 0)).select(F.col("a").alias("cluster"), "feature_id", "z", "log2fc", "bh", "seen")
        bare = everyone.join(out["markers"].groupBy(F.col("cluster").alias("a")).agg(F.count("*").alias("m")), "a", "left").where(F.coalesce("m", F.lit(0)) < min_markers).count()
        notes.append(note("cluster markers", "WARN" if bare else "PASS", f"{bare} clusters with under {min_markers}", "a cluster without markers can't be named"))
    if batches is not None:
        mixed = apply(inference.batch_dominance(), rows=out["clusters"].join(batches, "id").select("cluster", "batch"))
        single = mixed.where("dominated").count()
        notes.append(note("batch mixing within clusters", "WARN" if single else "PASS", f"{single} clusters of one batch", "such a cluster may be that batch"))
    return out, notes


def annotate_stage(expr: DataFrame, obs: DataFrame, panel: DataFrame, reference: DataFrame | None = None, least_seen: float = 0.05, least_named: float = 0.5) -> tuple[dict[str, DataFrame], list[dict]]:
    """Panel scores of groups, the calls made from them, and how well the panel carries them. ``obs`` is (unit_id, grp),
    ``panel`` (cell_type, gene, sign); ``reference`` (unit_id, label) holds names from a labelled reference.

    Suggested negatives of a type are positives that it doesn't share, of the types it is never seen with; they are given
    out, not used: used unseen, they turn right names into ambiguous ones.
    """
    what = CATALOGUES["annotate"]
    note = lambda check, status, found, why: record(check, status, what[check], found, why)
    stats = apply(matrix.rescaled(), stats=apply(matrix.group_stats(), expr=expr, obs=obs)).persist()
    scores = structure.kept(apply(enrich.panel_scores(), stats=stats, panel=panel))
    sized = scores.join(obs.groupBy("grp").agg(F.count("*").alias("n_cells")), "grp")
    given = {"scores": sized}
    if reference is not None:
        votes = apply(inference.majority_label(), rows=obs.join(reference, "unit_id").select(F.col("grp").alias("cluster"), "label")).select(F.col("cluster").alias("grp"), F.lower("label").alias("said"))
        known = panel.select(F.col("cell_type").alias("vote")).distinct()
        votes = structure.kept(votes.join(known, F.lower("vote") == F.col("said"), "left").select("grp", "vote"))
        given["votes"] = votes  # a vote for what isn't in the panel says nothing
    calls = structure.kept(apply(enrich.called_types(reference is not None), **given).join(obs.groupBy("grp").agg(F.count("*").alias("n_cells")), "grp"))
    seen = stats.groupBy(F.upper("feature_id").alias("gene")).agg(F.max("detected").alias("top"))
    genes = panel.select("cell_type", F.upper(F.trim("gene")).alias("gene"), "sign").distinct().join(seen, "gene", "left").persist()
    each = genes.groupBy("cell_type").agg(*[F.count(F.when((F.col("sign") == "+") & x, 1)).alias(n) for n, x in (("given", F.lit(True)), ("present", F.col("top").isNotNull()), ("usable", F.col("top") >= least_seen))], F.count(F.when(F.col("sign") == "-", 1)).alias("negatives"))
    f = each.agg(F.count("*").alias("types"), *[F.count(F.when(x, 1)).alias(n) for n, x in (("absent", F.col("present") == 0), ("lone", F.col("given") < 2), ("thin", (F.col("usable") < F.least(F.lit(3), "given")) | (F.col("usable") < 2)), ("open", F.col("negatives") == 0))]).first()
    sparse = genes.where((F.col("sign") == "+") & (F.col("top") < least_seen)).select("gene").distinct().count()
    named = calls.where("tier IN ('confident', 'probable')")
    tiers = {r.tier: r["count"] for r in calls.groupBy("tier").count().collect()}
    cells = calls.agg(F.sum(F.when(F.col("tier").isin("confident", "probable"), F.col("n_cells")).otherwise(0)).alias("named"), F.sum("n_cells").alias("n")).first()
    share = (cells.named or 0) / max(cells.n or 0, 1)
    conflicts = named.join(scores, (named["grp"] == scores["grp"]) & (named["label"] == scores["cell_type"])).where("negatives_on > 0").count()
    markers = apply(enrich.group_scores(50), expr=expr, obs=obs).select("grp", F.col("feature_id").alias("gene"))
    bare = apply(enrich.shared_markers(), markers=markers, panel=panel, calls=named.select("grp", "label")).where("n_shared = 0").count()
    twice = named.groupBy("label").count().where("count > 1").count()
    unfound = each.join(named.select(F.col("label").alias("cell_type")), "cell_type", "left_anti").count()
    positives = genes.where("sign = '+'").select("cell_type", "gene")
    others = positives.alias("o").join(each.select("cell_type").alias("t"), F.col("o.cell_type") != F.col("t.cell_type")).select(F.col("t.cell_type").alias("cell_type"), "o.gene").distinct()
    suggested = others.join(positives, ["cell_type", "gene"], "left_anti").join(genes.where("sign = '-'").select("cell_type", "gene"), ["cell_type", "gene"], "left_anti")
    notes = [
        note("marker panel", "WARN" if f.absent else "PASS", f"{f.absent} of {f.types} types have no marker in the data", "they can't be called"),
        note("panel strength", "WARN" if f.lone else "PASS", f"{f.lone} types with one marker", "one gene is no evidence"),
        note("enough usable markers", "WARN" if f.thin else "PASS", f"{f.thin} types with too few", "they score 0"),
        note("sparse panel genes", "INFO", f"{sparse} set aside", "genes that are hardly ever seen say nothing"),
        note("negative markers", "INFO" if f.open else "PASS", f"{f.open} types without any", "without them mixed groups pass for pure ones"),
        note("annotation tiers", "INFO", ", ".join(f"{k} {v}" for k, v in sorted(tiers.items())), "not all names are equally sure"),
        note("cells named", "PASS" if share >= least_named else "WARN", f"{share:.2f} of the cells", "the others need better markers"),
        note("negative marker conflicts", "WARN" if conflicts else "PASS", f"{conflicts} named groups", "the group may be mixed"),
        note("data-driven marker support", "WARN" if bare else "PASS", f"{bare} named groups without a shared marker", "panel and data disagree"),
        note("same type in several clusters", "INFO", f"{twice} names", "subtypes, states, or one type split"),
        note("panel types not found", "INFO", f"{unfound} types", "absent, or not told apart"),
    ]
    if reference is not None:
        said = named.join(votes.where("vote IS NOT NULL"), "grp").agg(F.count("*").alias("n"), F.count(F.when(F.col("label") == F.col("vote"), 1)).alias("same")).first()
        notes.append(note("reference agreement", "INFO" if not said.n else "PASS" if said.same >= 0.5 * said.n else "WARN", f"{said.same} of {said.n} named groups", "two ways to a name that agree are better than one"))
    return {"scores": scores, "calls": calls, "suggested_negatives": suggested, "panel_use": each}, notes


def compare_stage(
    cells: DataFrame, values: DataFrame, ref: str, test: str, kind: str = "counts", alpha: float = 0.05, min_effect: float = 0.5, min_cells: int = 10, min_units: int = 3, pure: float = 0.9,
    least_consistent: float = 0.75, most_unnamed: float = 0.2, n_swaps: int = 20, seed: int = 0, method: str = "least squares",
) -> tuple[dict[str, DataFrame], list[dict]]:
    """Gate, shares of types, effects on totals of samples with BH, swap null and consistency, for paired and unpaired samples.

    ``cells`` (unit_id, sample, condition, batch, grp, ptype) has a row a cell, ``values`` (unit_id, feature, value) what isn't zero:
    counts, or log values if ``kind`` is "log". Counts are compared by ``method`` "least squares" on logs or "negative binomial"; the null under
    swapped labels is that of the former. The comparison ends with the gate where a condition has no cells, fewer than two
    samples have enough, or no type can be tested; a batch that follows the condition is a warning, carried on.
    """
    what = CATALOGUES["compare"]
    note = lambda check, status, found, why: record(check, status, what[check], found, why)
    gate = structure.kept(apply(designs.gate(ref, test, min_cells, min_units, pure), cells=cells))
    g = gate.first()
    notes = [note("groups", "INFO" if g.ref_cells and g.test_cells else "FAIL", f"{g.ref_cells} cells of {ref}, {g.test_cells} of {test}, {g.n_left_out} of others", "two conditions are needed; others are left out")]
    notes.append(note("replicates", g.replicates, f"{g.n_ref} and {g.n_test} samples of {min_cells} cells or more", "cells of one sample aren't replicates"))
    if "FAIL" in (notes[0]["status"], g.replicates):
        return {"gate": gate}, notes
    types = apply(designs.types(ref, test, min_cells, min_units, pure), cells=cells, gate=gate).persist()
    listed = types.orderBy("ptype").collect()
    tested, one_sided = [r.ptype for r in listed if r.testable], [r.ptype for r in listed if r.follows]
    left = [f"{r.ptype} ({r.n_ref} and {r.n_test} samples)" for r in listed if not r.testable]
    unnamed = g.n_unnamed / (g.ref_cells + g.test_cells)
    notes += [
        note("pairing", g.pairing, f"{g.n_both} of {g.n_samples} samples in both conditions", "samples in both are compared with themselves; a few of many can't be"),
        note("condition vs batch", g.batch, f"{g.n_single} of {g.n_batches} batches hold one condition", "an effect of the batch would look like one of the condition" if g.n_single else "batches hold both conditions"),
        note("clusters follow condition", g.clusters, f"{g.n_pure} of {g.n_groups} groups", "the condition may have made the groups"),
        note("cell types follow condition", "WARN" if one_sided else "PASS", ", ".join(one_sided) or "none", "the name may have moved with the condition instead of the cells"),
        note("testable cell types", "FAIL" if not tested else "WARN" if left else "PASS", f"{len(tested)} of {len(listed)}" + (f"; not: {'; '.join(left)}" if left else ""), "the others have too few cells or samples"),
        note("unlabelled cells", "WARN" if unnamed >= most_unnamed else "INFO", f"{100 * unnamed:.1f} %", "they are in no type's results"),
    ]
    if not tested:
        return {"gate": gate, "types": types}, notes
    shares = structure.kept(apply(designs.shares(ref, test, min_cells), cells=cells, gate=gate))
    by_clr = apply(designs.share_effects(ref, test), shares=shares, gate=gate).withColumn("p_clr", t_p(F.col("clr_t"), F.col("df")))
    by_odds = glm.quasi_binomial(shares, test, g.paired).select("ptype", "log_odds", "odds_t", "odds_df", "dispersion")
    abundance = structure.kept(by_clr.join(by_odds, "ptype", "left").withColumn("p_odds", t_p(F.col("odds_t"), F.col("odds_df"))))
    each = abundance.select(F.col("ptype").alias("id"), F.explode(F.create_map(F.lit("clr"), "p_clr", F.lit("odds"), "p_odds")).alias("model", "p")).where("p IS NOT NULL")
    fdr = apply(inference.multiplicity("model", alpha), p=each).groupBy("id").pivot("model", ["clr", "odds"]).agg(F.first("bh")).toDF("ptype", "fdr_clr", "fdr_odds")
    abundance = abundance.join(fdr, "ptype", "left")
    abundance = abundance.withColumn("agree", F.coalesce((F.col("fdr_clr") < alpha) & (F.col("fdr_odds") < alpha), F.lit(False))).withColumn("caution", F.col("ptype").isin(one_sided)).persist()
    kept = structure.kept(apply(designs.kept_units(ref, test, min_cells), cells=cells, gate=gate).where(F.col("ptype").isin(tested)))
    bulk = structure.kept(apply(designs.bulk(kind == "log"), cells=cells, values=values, kept=kept))
    if kind == "log":
        logs = bulk.select("ptype", "sample", "condition", "feature", (F.col("total") / F.log(F.lit(2.0))).alias("v")).persist()
    else:
        logs = structure.kept(apply(designs.logs(), bulk=bulk, tested=structure.kept(apply(designs.tested_features(min_units), bulk=bulk))))
    if method == "negative binomial" and kind != "log":
        tested = bulk.join(logs.select("ptype", "feature").distinct(), ["ptype", "feature"], "left_semi")
        fit = glm.negative_binomial(tested, kept, ref, test, g.paired)
        result = fit.select("ptype", "feature", "base_mean", F.col("log2fc").alias("effect"), F.col("stat").alias("t_stat"), "dispersion", "converged", z_p(F.col("stat")).alias("p"))
    else:
        result = apply(designs.effects(ref, test), logs=logs, kept=kept, gate=gate).withColumn("p", t_p(F.col("t_stat"), F.col("df")))
    result = structure.kept(result.withColumn("id", F.concat_ws(" ", "ptype", "feature")))
    called = apply(inference.multiplicity("ptype", alpha), p=result.where("p IS NOT NULL").select("id", "ptype", "p")).select("id", "ptype", "bh", "bh_called")
    result = result.join(called, ["id", "ptype"], "left").withColumn("significant", F.coalesce(F.col("bh_called") & (F.abs("effect") >= min_effect), F.lit(False))).persist()
    null = sampling.swap_null(logs, kept, ref, test, g.paired, n_swaps, alpha, seed).persist()
    consistency = apply(designs.consistency(ref, test), logs=logs, kept=kept, called=result.where("significant"), gate=gate).persist()
    counts = result.groupBy("ptype").agg(F.count_if("bh_called").alias("real"), F.count("*").alias("tested"))
    swaps = null.groupBy("ptype").agg(F.median("called").alias("mid"), F.count("*").alias("n"))
    by_type = {r.ptype: r for r in counts.join(swaps, "ptype", "left").collect()}
    noisy = [t for t, r in by_type.items() if r.mid is not None and r.mid > max(0.01 * r.tested, 0.2 * r.real)]
    unsure = [r.ptype for r in consistency.where(F.col("consistency") < least_consistent).collect()]
    n_agree, n_types = abundance.where("agree").count(), abundance.count()
    notes += [
        note("abundance", "INFO", f"{n_agree} of {n_types} types differ in both models", "shares sum to one, so one type's rise is the others' fall"),
        note("differential expression", "INFO", f"{result.where('significant').count()} of {result.count()} called", "counted at the corrected level and least effect"),
        note("null check", "INFO" if not any(r.mid is not None for r in by_type.values()) else "WARN" if noisy else "PASS", ", ".join(noisy) or f"no more than expected in {len(by_type)} types", "calls under swapped labels are false"),
        note("sample consistency", "INFO" if not g.paired else "WARN" if unsure else "PASS", ", ".join(unsure) or "samples agree" if g.paired else "needs pairs", "a few samples may carry the mean"),
    ]
    return {"gate": gate, "types": types, "result": result, "shares": shares, "abundance": abundance, "consistency": consistency, "swap_null": null, "units": kept}, notes


def interpret_stage(result: DataFrame, ranked: DataFrame, sets: DataFrame, background: DataFrame, n_perm: int = 1500) -> dict[str, DataFrame]:
    """Over-representation of the called features, its significant terms without repeats, and enrichment along the ranked
    list (feature_id, stat, and grp to do it by type), generic terms flagged."""
    usable = apply(enrich.sets_in_background(3, 500), sets=sets, background=background).persist()
    over = apply(enrich.overlaps(), genes=result, background=background, sets=usable)
    ora = apply(enrich.hypergeometric(), overlaps=over)
    flags = apply(enrich.generic_terms(), terms=usable.select("term").distinct())
    lists = ranked if "grp" in ranked.columns else ranked.withColumn("grp", F.lit("all"))
    gsea = sampling.enrichment(lists.select(F.col("grp").cast("string").alias("grp"), "feature_id", "stat"), usable, n_perm, 3)
    return {"ora": ora.join(flags, "term"), "kept_terms": trimmed(ora.where("fdr < 0.05").select("term", "p"), usable), "gsea": gsea.join(flags, "term")}


def assemble_stage(expr: DataFrame, columns: DataFrame, obs: DataFrame, declared: str | None = None, expected: dict[str, str] | None = None) -> tuple[dict[str, DataFrame], list[dict]]:
    """One matrix with its metadata, if they belong together: ids and their order, values, scale, published figures.

    ``columns`` is (pos, id, label) as the matrix file has them, ``obs`` (unit_id, label, ...); ``expected`` maps shape and
    counts (units, features, label=<value>, different <column>) to what was published.
    """
    notes = [record(r.check_name, r.status, CATALOGUES["assemble"][r.check_name], str(r.figure), "a shifted header gives every cell another cell's metadata") for r in apply(matrix.order_checks(), a=columns, b=obs.select(F.col("unit_id").alias("id"), "label")).collect()]
    v = apply(matrix.detect_scale(), expr=expr).first()
    odd = expr.where("value IS NULL OR isnan(value) OR abs(value) = double('inf')").count()
    notes += [
        record("NaN/inf values", "FAIL" if odd else "PASS", "values that are no numbers", str(odd), "they spread through every sum"),
        record("negative values", "WARN" if v.negative else "PASS", "values below zero", str(v.negative), "counts and their logs have none"),
        record("detected scale", "INFO", "scale of the values", v.scale, "it decides how values are normalised"),
    ]
    if declared is not None:
        notes.append(record("scale matches declaration", "PASS" if declared == v.scale else "FAIL", "declared scale", f"{declared}, found {v.scale}", "a wrong scale makes every later number wrong"))
    if expected:
        found = {"units": str(columns.count()), "features": str(expr.select("feature_id").distinct().count())}
        found |= {f"label={r.label}": str(r["count"]) for r in obs.groupBy("label").count().collect()}
        found |= {f"different {c}": str(obs.select(c).distinct().count()) for c in obs.columns}
        figures = expr.sparkSession.createDataFrame([(k, found.get(k), str(x)) for k, x in expected.items()], "name string, observed string, expected string")
        notes += [record(r.name, r.status, "a published figure", f"{r.observed}, expected {r.expected}", "other figures are another dataset", "published numbers") for r in apply(matrix.expected_values(), figures=figures).collect()]
    return {"expr": expr, "obs": obs, "scale": expr.sparkSession.createDataFrame([(v.scale,)], "scale string")}, notes


def scaled_vectors(expr: DataFrame, obs: DataFrame, selected: DataFrame, most: float = 10.0) -> tuple[DataFrame, int]:
    """(id, unit_id, v): units as vectors of the selected features, each of mean 0 and variance 1, cut at ``most`` and
    centred again; and how many features they have."""
    place = apply(matrix.first_of_each(), rows=selected.select(F.col("feature_id").alias("id"), F.xxhash64("feature_id").alias("pos"))).select(F.col("id").alias("feature_id"), (F.col("place") - 1).alias("c"))
    width = place.count()
    units = apply(matrix.first_of_each(), rows=obs.select(F.col("unit_id").alias("id"), F.xxhash64("unit_id").alias("pos"))).select(F.col("place").alias("id"), F.col("id").alias("unit_id"))
    n = float(units.count())
    cells = expr.join(place, "feature_id").join(units, "unit_id").select("id", "c", "value")
    stats = cells.groupBy("c").agg((F.sum("value") / n).alias("m"), F.sqrt(F.greatest((F.sum(F.col("value") ** 2) - F.sum("value") ** 2 / n) / (n - 1), F.lit(0.0))).alias("sd"))
    stats = place.select("c").join(stats, "c", "left").select("c", F.coalesce("m", F.lit(0.0)).alias("m"), F.when(F.col("sd") > 0, F.col("sd")).otherwise(F.lit(1.0)).alias("sd"))
    cut = lambda x: F.greatest(F.least((x - F.col("m")) / F.col("sd"), F.lit(most)), F.lit(-most))
    z = cells.join(F.broadcast(stats), "c").select("id", "c", cut(F.col("value")).alias("z"), cut(F.lit(0.0)).alias("zero"))
    again = z.groupBy("c").agg(F.sum(F.col("z") - F.col("zero")).alias("s"))
    base = stats.join(again, "c", "left").select("c", cut(F.lit(0.0)).alias("zero"), (cut(F.lit(0.0)) + F.coalesce("s", F.lit(0.0)) / n).alias("mean"))
    zeros = base.agg(F.transform(F.array_sort(F.collect_list(F.struct("c", (F.col("zero") - F.col("mean")).alias("x")))), lambda x: x["x"]).alias("zeros"))
    own = z.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("c").cast("int"), F.col("z") - F.col("zero")))).alias("own"))
    rows = units.join(own, "id", "left").crossJoin(F.broadcast(zeros))
    v = F.transform("zeros", lambda x, i: x + F.coalesce(F.try_element_at("own", i), F.lit(0.0)))
    return rows.select("id", "unit_id", F.when(F.col("own").isNull(), F.col("zeros")).otherwise(v).alias("v")), width


def dimred_stage(
    expr: DataFrame, obs: DataFrame, selected: DataFrame, batch: str | None = None, technical: tuple[str, ...] = ("n_genes", "total", "pct_mt"), max_pcs: int = 50, min_pcs: int = 5, runs: int = 10,
    threshold: float = 0.9, basis: str = "signal", k: int = 15, tech_r: float = 0.5, tech_share: float = 0.3, batch_limit: float = 0.2, correct: bool | None = None, seed: int = 0,
) -> tuple[dict[str, DataFrame], list[dict]]:
    """Components of the selected features, how many to keep, what drives them, batch correction and the neighbour graph.

    ``obs`` has unit_id, the technical columns it has values for, and the batch. The number kept is the fewest that hold
    ``threshold`` of what rises above columns shuffled one by one. ``correct`` None corrects if the batch explains over
    ``batch_limit`` of the components kept.
    """
    spark, what = expr.sparkSession, CATALOGUES["dimred"]
    vec, width = scaled_vectors(expr, obs, selected)
    vec = structure.kept(vec)
    n = vec.count()
    most = min(max_pcs, n - 1, width - 1)
    scores, value, _ = structure.principal_components(vec, width, most)
    null = structure.shuffled_variances(vec, width, most, runs, seed)
    total = float(structure.gram(vec, width)[1].trace()) / max(n - 1, 1)
    eig = spark.createDataFrame([(i + 1, float(e), float(z), float(e / max(total, 1e-12))) for i, (e, z) in enumerate(zip(value, null, strict=True))], "pc int, eig double, null_max double, ratio double")
    choice = apply(structure.component_choice(threshold, basis), eig=eig).first()
    keep = min(max(min_pcs, choice.n), most)
    beyond = max(0, keep - max(choice.lead, min_pcs))
    note = lambda check, status, found, why: record(check, status, what[check], found, why)
    notes = [
        note("PCA on selected genes", "PASS", f"{width} features, {n} units, {most} components", "later steps see the components only"),
        note("number of PCs chosen from the data", "WARN" if choice.lead < min_pcs else "INFO", f"{keep} kept, {choice.lead} above {runs} shuffles, elbow at {choice.elbow}", "few components above the null mean little structure"),
        note("variance threshold reached", "PASS" if choice.reached else "WARN", f"target {threshold}", "what isn't held is lost"),
        note("chosen PCs beat shuffled data", "WARN" if beyond else "PASS", f"{beyond} of {keep} don't", "they are noise"),
    ]
    pcs = structure.kept(scores.select("id", F.slice("scores", 1, keep).alias("v")).join(vec.select("id", "unit_id"), "id"))
    long = pcs.select("id", "unit_id", F.posexplode("v").alias("pc", "x"))
    logs = [(c, F.log1p(F.col(c).cast("double")) if c in ("total", "n_genes") else F.col(c).cast("double")) for c in technical if c in obs.columns]
    strong: dict[int, str] = {}
    if logs:
        driver = obs.select("unit_id", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), x.alias("y")) for c, x in logs])).alias("t")).select("unit_id", "t.*")
        r = long.join(driver, "unit_id").groupBy("pc", "name").agg((F.covar_pop("x", "y") / F.nullif(F.stddev_pop("x") * F.stddev_pop("y"), F.lit(0.0))).alias("r")).where(F.abs("r") > tech_r)
        strong = {x.pc: x.name for x in r.collect()}
    share = float(sum(value[i] for i in strong) / max(value[:keep].sum(), 1e-12))
    notes.append(note("PCs driven by technical covariates", "INFO" if not logs else "WARN" if share > tech_share else "PASS", f"components {sorted(i + 1 for i in strong)}, {share:.2f} of what is kept" if logs else "no technical columns", "such groups are groups of measurement"))
    out = {"eig": eig, "pcs": pcs, "used": pcs}
    if batch is not None and batch in obs.columns:
        labels = pcs.select("id", "unit_id").join(obs.select("unit_id", F.col(batch).cast("string").alias("label")), "unit_id").select("id", "label").persist()
        explained = lambda v: apply(inference.eta_squared(), rows=v.select("id", F.posexplode("v").alias("col", "value")).join(labels, "id").select(F.col("label").alias("grp"), "col", "value")).where("col = -1").first().r2
        mixed = lambda v: structure.mixing(structure.nearest(v.select("id", "v"), min(30, n - 1)), labels).first().mixing
        groups, before, mix = labels.select("label").distinct().count(), explained(pcs), mixed(pcs)
        wanted = groups > 1 and (correct or correct is None and before > batch_limit)
        notes.append(note("batch structure in PCs", "PASS" if before <= batch_limit else "INFO" if wanted else "WARN", f"{groups} batches explain {before:.2f}, mixing {mix:.2f}", "batches can pass for groups"))
        if wanted:
            # clusters for the correction are found within batches' common space: by the sign of the components least tied to the batch
            side = pcs.select("id", F.lit(0).alias("cluster"))
            fixed = structure.kept(structure.centred_batches(pcs.select("id", "v"), labels.withColumnRenamed("label", "batch"), side).join(pcs.select("id", "unit_id"), "id"))
            after, mix_after = explained(fixed), mixed(fixed)
            good = after < before and mix_after >= mix and after <= batch_limit
            notes.append(note("batch correction effect", "PASS" if good else "WARN", f"explained {before:.2f} to {after:.2f}, mixing {mix:.2f} to {mix_after:.2f}", "correction can't tell batch from biology: known groups must stay apart"))
            out["used"] = fixed
    elif correct:
        notes.append(note("batch correction effect", "FAIL", "no batch column", "there is nothing to correct by"))
    graph = structure.kept(structure.shared_neighbour_graph(structure.nearest(out["used"].select("id", "v"), min(k, n - 1))))
    pieces = structure.graph_components(graph, pcs.select("id"))
    alone = structure.stranded(pieces).count()
    notes.append(note("neighbor graph fragments", "PASS" if alone <= 0.01 * n else "WARN", f"{pieces.select('component').distinct().count()} pieces, {alone} units in pieces of under 10", "stranded units join no group"))
    return out | {"graph": graph}, notes


def trimmed(terms: DataFrame, sets: DataFrame, most: float = 0.5) -> DataFrame:
    """Terms of ``terms`` (term, p) in order of p that overlap every kept one by less than ``most`` (Jaccard). Greedy by
    nature: members travel as one array per term and the order is walked in a fold over the few terms that were called."""
    m = terms.join(sets, "term").groupBy("term", "p").agg(F.sort_array(F.collect_set("feature_id")).alias("genes"))
    ordered = m.agg(F.array_sort(F.collect_list(F.struct("p", "term", "genes"))).alias("all"))
    fits = lambda kept, x: ~F.exists(kept, lambda k: F.size(F.array_intersect(k["genes"], x["genes"])) / F.greatest(F.size(F.array_union(k["genes"], x["genes"])), F.lit(1)) >= most)
    fold = F.aggregate("all", F.slice("all", 1, 0), lambda kept, x: F.when(fits(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    return ordered.select(F.explode(fold).alias("k")).select("k.term", "k.p")


def synthetic_study(spark: SparkSession, seed: int = 0, features: int = 800, planted: int = 40) -> tuple[DataFrame, DataFrame]:
    """(long, meta): 24 samples in two groups and three batches; the first features are higher in the treated, batches
    shift all, low values are missing, one sample is weak and one a copy of another."""
    s = spark.range(24).select(F.format_string("S%02d", F.col("id") + 1).alias("sample"), F.when(F.col("id") < 12, "control").otherwise("treated").alias("grp"), F.when(F.col("id") == 10, 9).otherwise(F.col("id")).alias("draw"))
    s = s.withColumn("batch", F.concat(F.lit("B"), (F.col("draw") % 3 + 1).cast("string")))
    f = spark.range(features).select(F.format_string("P%04d", "id").alias("feature"), "id")

    def noise(*keys):
        u = [(F.pmod(F.xxhash64(F.lit(seed), F.lit(i), *keys), F.lit(1 << 40)) + 1) / float((1 << 40) + 2) for i in (1, 2)]
        return F.sqrt(-2 * F.log(u[0])) * F.cos(2 * 3.141592653589793 * u[1])

    base = 20 + 2 * noise("id")
    effect = F.when((F.col("grp") == "treated") & (F.col("id") < planted), 1.0).otherwise(0.0)
    batch = 0.5 * noise("id", "batch")
    value = base + effect + batch + 0.3 * noise("id", "draw") - F.when(F.col("sample") == "S07", 3.0).otherwise(0.0)
    long = s.join(f).select("sample", "feature", value.alias("value")).where("value > 17")
    return long, s.select("sample", "grp", "batch")


def worked_example(spark: SparkSession) -> tuple[DataFrame, str]:
    """Intake, quality, normalisation, structure and comparison of `synthetic_study`: the result table and a summary."""
    long, meta = synthetic_study(spark)
    long = long.persist()
    copies = alike.near_duplicates(long, 100, 0.9999).collect()
    samples = long.groupBy("sample").agg(F.sum(F.pow(F.lit(2.0), "value")).alias("total"), F.count("*").cast("double").alias("seen"), F.median("value").alias("mid"))
    flags = [r.sample for r in apply(matrix.robust_flags(), samples=samples).where("weak OR outlier").collect()]
    out = {r.b for r in copies} | set(flags)
    left = structure.kept(long.where(~F.col("sample").isin(list(out))) if out else long)
    ends = structure.kept(left.select("sample").distinct()), structure.kept(left.select("feature").distinct())
    grid = structure.kept(ends[0].crossJoin(ends[1]).join(left, ["sample", "feature"], "left").select(F.col("sample").alias("unit_id"), F.col("feature").alias("feature_id"), "value"))
    intake = [record(r.check_name, r.status, r.check_name, str(r.figure), "missing or impossible values mislead") for r in apply(prose_checks.intake(), grid=grid).collect()]
    centred = apply(matrix.median_centred(), grid=left.select(F.col("sample").alias("unit_id"), F.col("feature").alias("feature_id"), "value"))
    full = apply(matrix.present_and_filled(), grid=structure.kept(grid.select("unit_id", "feature_id").join(centred, ["unit_id", "feature_id"], "left")))
    # batches are taken off per feature before the groups are compared
    x = full.join(F.broadcast(meta.withColumnRenamed("sample", "unit_id")), "unit_id")
    own = x.groupBy("feature_id", "batch").agg(F.avg("value").alias("m"))
    logs = x.join(own, ["feature_id", "batch"]).select(F.lit("all").alias("ptype"), F.col("feature_id").alias("feature"), F.col("unit_id").alias("sample"), F.col("grp").alias("condition"), (F.col("value") - F.col("m")).alias("v"))
    result = apply(compare.pooled_t("control", "treated"), logs=logs).withColumn("p", t_p(F.col("t_stat"), F.col("df")))
    called = apply(inference.multiplicity(), p=result.select(F.col("feature").alias("id"), "p"))
    table = result.join(called.select(F.col("id").alias("feature"), "bh", "bh_called"), "feature").withColumn("called", F.col("bh_called") & (F.abs("effect") > 0.4854))
    quality = [record("samples", "WARN" if out else "PASS", "weak, outlying or copied samples", ", ".join(sorted(out)) or "none", "they were left out")]
    return table, "\n\n".join([run_summary([{"name": "intake", "records": intake}, {"name": "qc", "records": quality}]), card("intake", intake), card("qc", quality)])


def leave_one_out(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Held-out areas of a signature and the verdict they give."""
    areas = learn.held_out_auc(rows)
    return areas, learn.state_verdict(areas)
