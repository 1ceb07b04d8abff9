"""Queries that need iteration, linear algebra or random labels; SQL is given where it can say the same."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvellum.functions.dist import chi2_p, reported_p, t_p, z_p
from corvellum.operators import alike, glm, learn, lint, ranks, records, sampling, structure, variable
from corvellum.plans import statistics
from corvellum.plans.sqlplan import apply, from_sql

WIDTH = 64


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")


def pca(spark, sf_dir):
    _, value, _ = structure.principal_components(_vec(spark, sf_dir), WIDTH, 10)
    return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(value)], "pc int, variance double")


def pca_scores(spark, sf_dir):
    return structure.principal_components(_vec(spark, sf_dir), WIDTH, 5)[0]


def parallel_analysis(spark, sf_dir):
    v = _vec(spark, sf_dir)
    value = structure.principal_components(v, WIDTH, 20)[1]
    total = float(np.trace(structure.gram(v, WIDTH)[1])) / max(v.count() - 1, 1)
    null = structure.shuffled_variances(v, WIDTH, 20)
    eig = spark.createDataFrame([(i + 1, float(e), float(z), float(e / total)) for i, (e, z) in enumerate(zip(value, null, strict=True))], "pc int, eig double, null_max double, ratio double")
    return apply(structure.component_choice(), eig=eig)


def knn(spark, sf_dir):
    return structure.nearest(_vec(spark, sf_dir), 5).select("id", "other", F.round("distance", 5).alias("distance"), F.col("place").cast("long").alias("place"))


def knn_mixing(spark, sf_dir):
    return structure.mixing(structure.nearest(_vec(spark, sf_dir), 10), _labels(spark, sf_dir)).select(F.round("mixing", 6).alias("mixing"))


def mean_silhouette(spark, sf_dir):
    return structure.silhouette(_vec(spark, sf_dir), _labels(spark, sf_dir)).agg(F.round(F.avg("silhouette"), 6).alias("silhouette"))


def nearest_centroid(spark, sf_dir):
    return structure.nearest_centroids(_vec(spark, sf_dir), _labels(spark, sf_dir))


def components_stranded(spark, sf_dir):
    near = structure.nearest(_vec(spark, sf_dir), 2)
    edges = near.select(F.col("id").alias("src"), F.col("other").alias("dst"))
    return structure.graph_components(structure.both_ways(edges), _vec(spark, sf_dir).select("id"))


def louvain(spark, sf_dir):
    return structure.communities(structure.shared_neighbour_graph(structure.nearest(_vec(spark, sf_dir), 10)), rounds=8)


def batch_centred(spark, sf_dir):
    v, batch = _vec(spark, sf_dir), _labels(spark, sf_dir).select("id", (F.col("label") % 2).alias("batch"))
    return structure.centred_batches(v, batch, _labels(spark, sf_dir).select("id", F.lit(0).alias("cluster")))


def nmf_programs(spark, sf_dir):
    v = _vec(spark, sf_dir).select("id", F.transform("v", lambda x: F.greatest(x, F.lit(0.0))).alias("v"))
    _, _, _, h = structure.stable_programs(v, WIDTH, ks=(2, 3, 4), restarts=3, rounds=60)
    return spark.createDataFrame([(k, i, float(x)) for k, row in enumerate(h) for i, x in enumerate(row)], "program int, feature int, loading double")


def state_auc(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    rows = e.select(F.col("vec_id").alias("id"), F.concat(F.lit("s"), (F.col("vec_id") % 4).cast("string")).alias("sample"), (F.col("label") < 5).cast("int").alias("y"), F.col("embedding").cast("array<double>").alias("v"))
    return learn.held_out_auc(rows)


def reference_labels(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "value")).withColumn("feature_id", F.concat(F.lit("f"), F.col("i").cast("string")))
    ref = e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("unit_id"), F.col("label").cast("string").alias("label"), "feature_id", "value")
    return learn.reference_labels(e.where("vec_id % 2 = 1").select(F.col("vec_id").alias("unit_id"), "feature_id", "value"), ref, 50, 3).withColumn("r", F.round("r", 6))


def swap_null(spark, sf_dir):
    d = statistics.DESIGNS[0]
    return sampling.swap_null(from_sql(d["logs"])(spark, sf_dir), from_sql(d["kept"])(spark, sf_dir), "F", "O")


def swap_null_unpaired(spark, sf_dir):
    d = statistics.DESIGNS[1]
    return sampling.swap_null(from_sql(d["logs"])(spark, sf_dir), from_sql(d["kept"])(spark, sf_dir), "F", "O", paired=False)


def _quasi_binomial(spark, sf_dir, paired):
    out = glm.quasi_binomial(from_sql(statistics.DESIGNS[0 if paired else 1]["shares"])(spark, sf_dir), "O", paired)
    return out.select("ptype", *[F.round(c, 5).alias(c) for c in ("log_odds", "odds_t", "dispersion")], "odds_df", "converged")


def abundance_glm(spark, sf_dir):
    return _quasi_binomial(spark, sf_dir, True)


def abundance_glm_unpaired(spark, sf_dir):
    return _quasi_binomial(spark, sf_dir, False)


def _variable_counts(spark, sf_dir, batch, top):
    expr = from_sql(statistics.EXPR)(spark, sf_dir)
    obs = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("unit_id"), batch.alias("batch"))
    return variable.variable_counts(expr, obs, top).withColumn("score", F.round("score", 6))


def variable_counts(spark, sf_dir):
    return _variable_counts(spark, sf_dir, F.lit("all"), 10)


def variable_counts_by_batch(spark, sf_dir):
    return _variable_counts(spark, sf_dir, F.pmod(F.col("s_suppkey"), F.lit(3)), 10)


def nb_model(spark, sf_dir):
    d = statistics.DESIGNS[0]
    out = glm.negative_binomial(from_sql(d["bulk"])(spark, sf_dir), from_sql(d["kept"])(spark, sf_dir), "F", "O", True)
    return out.select("ptype", "feature", *[F.round(c, 5).alias(c) for c in ("base_mean", "log2fc", "stat", "dispersion")], "converged")


def permutation_difference(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("event_type") == "click").cast("int").alias("grp"), "value")
    return sampling.permutation_difference(e, 1000)


def pair_duplicates(spark, sf_dir):
    """Users whose mean values by event type correlate; the SQL of the name says the same."""
    long = _table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("sample"), F.col("event_type").alias("feature")).agg(F.avg("value").alias("value"))
    return alike.near_duplicates(long, 3, 0.9)


def correlations(spark, sf_dir):
    """In steps; the SQL of the name says the same."""
    return ranks.correlations(from_sql(statistics.XY)(spark, sf_dir))


def concordance(spark, sf_dir):
    return ranks.concordance(from_sql(statistics.RESULT_A)(spark, sf_dir), from_sql(statistics.RESULT_B)(spark, sf_dir), 0.3)


def paired_p(spark, sf_dir):
    t = from_sql(statistics.SQL["paired_t"])(spark, sf_dir)
    return t.withColumn("p", F.round(t_p(F.col("t_stat"), F.col("df")), 6))


def chi_square_p(spark, sf_dir):
    return from_sql(statistics.SQL["chi_square"])(spark, sf_dir).withColumn("p", F.round(chi2_p(F.col("chi2"), F.col("df")), 6))


def mann_whitney_p(spark, sf_dir):
    return from_sql(statistics.SQL["mann_whitney"])(spark, sf_dir).withColumn("p", F.round(z_p(F.col("z")), 6))


def ci_p_agrees(spark, sf_dir):
    """Intervals and p-values reported with each order: some of the p fit their interval, some don't."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 2 == 0).alias("ratio"), (F.col("o_totalprice") / 100_000).alias("x"))
    cis = o.select("id", "ratio", (F.col("x") + 1).alias("estimate"), F.col("x").cast("double").alias("low"), (F.col("x") + 2.5).alias("high"), (F.pmod(F.col("id"), F.lit(100)) / 1000.0 + 0.001).alias("p_reported"))
    return records.interval_agrees(cis).withColumn("p_from_interval", F.round("p_from_interval", 6)).withColumn("p_reported", F.round("p_reported", 6))


def recomputed_p(spark, sf_dir):
    """p-values of reported statistics of each kind, as many as there are orders."""
    k, x = F.col("o_orderkey"), F.col("o_totalprice") / 100_000
    test = F.get(F.array(*map(F.lit, ("t", "z", "r", "F", "chi2"))), (k % 5).cast("int"))
    df = _table(spark, sf_dir, "orders").select(k.alias("id"), test.alias("test"), F.when(test == "r", x / 10).otherwise(x).alias("stat"), (k % 30 + 3).cast("double").alias("df1"), (k % 50 + 5).cast("double").alias("df2"))
    return df.withColumn("p", F.round(reported_p(F.col("test"), F.col("stat"), F.col("df1"), F.col("df2")), 6))


def _revenue(spark, sf_dir):
    return from_sql(statistics.REVENUE)(spark, sf_dir).withColumn("stat", F.col("stat") - 200000)


def gsea(spark, sf_dir):
    """Brands along parts ranked by revenue, with 1,500 random sets of each size class."""
    return sampling.enrichment(_revenue(spark, sf_dir).withColumn("grp", F.lit("all")), from_sql(statistics.BRAND_SETS)(spark, sf_dir), 1500, 5)


def gsea_by_type(spark, sf_dir):
    """The same within each part type."""
    kinds = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("feature_id"), F.col("p_type").alias("grp"))
    return sampling.enrichment(_revenue(spark, sf_dir).join(kinds, "feature_id"), from_sql(statistics.BRAND_SETS)(spark, sf_dir), 1500, 3)


def lint_scripts(spark, sf_dir):
    """Scripts that break a rule or two each, as many as there are customers."""
    lines = ["import matplotlib.pyplot as plt", "# ax.imshow(m, cmap='jet')", "ax.imshow(m, cmap='turbo')", "ax.set_title('t', fontsize=6)", "fig.savefig('a.png')", "ax.pie(s, explode=e)", "x = df.fillna(0)", "ax.plot(x, color='Lime')", "y = np.random.normal()", "ax.bar(x, y)\nax.set_ylim(5, 9)", "ax.errorbar(x, y, yerr=s)"]
    some = _table(spark, sf_dir, "customer").select(F.concat(F.lit("s"), F.col("c_custkey").cast("string"), F.lit(".py")).alias("path"), F.col("c_custkey").alias("k"))
    picked = F.filter(F.array(*map(F.lit, lines)), lambda x, i: F.pmod(F.col("k") * (i + 3), F.lit(7)) < 3)
    return lint.lint(some.select("path", F.array_join(picked, "\n").alias("text")))


def worked_example(spark, sf_dir):
    """The general example on its own synthetic study."""
    from corvellum.plans.composites import worked_example as example

    return example(spark)[0]


def nb_p(spark, sf_dir):
    return from_sql(statistics.SQL["nb_wald"])(spark, sf_dir).withColumn("p", F.round(z_p(F.col("z")), 6))


QUERIES = {f.__name__: f for f in (pca, pca_scores, parallel_analysis, knn, knn_mixing, mean_silhouette, nearest_centroid, components_stranded, louvain, batch_centred, nmf_programs, state_auc, reference_labels, swap_null, swap_null_unpaired, abundance_glm, abundance_glm_unpaired, nb_model, variable_counts, variable_counts_by_batch, permutation_difference, pair_duplicates, correlations, concordance, paired_p, chi_square_p, mann_whitney_p, ci_p_agrees, recomputed_p, gsea, gsea_by_type, lint_scripts, worked_example, nb_p)}

_NEAR = """e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT a.id, b.id AS other, a.label, b.label AS other_label, list_distance(a.v, b.v) AS distance FROM e a JOIN e b ON a.id <> b.id),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, other) AS place FROM d)"""



def _variable_sql(batch: str, top: int) -> str:
    """Local quadratics in closed form: the fit at a point is its constant term, by determinants of weighted sums about the point."""
    w = lambda k: f"sum(w * power(d, {k}))"
    y = lambda k: f"sum(w * power(d, {k}) * y)"
    det = lambda a, b, c: f"({a[0]} * ({b[1]} * {c[2]} - {b[2]} * {c[1]}) - {a[1]} * ({b[0]} * {c[2]} - {b[2]} * {c[0]}) + {a[2]} * ({b[0]} * {c[1]} - {b[1]} * {c[0]}))"
    rows = [[f"w{i + j}" for j in range(3)] for i in range(3)]
    given = [[f"y{i}", *rows[i][1:]] for i in range(3)]
    sums = ", ".join([f"{w(k)} AS w{k}" for k in range(5)] + [f"{y(k)} AS y{k}" for k in range(3)])
    return f"""WITH o AS (SELECT s_suppkey AS u, {batch} AS b FROM supplier), size AS (SELECT b, CAST(count(*) AS DOUBLE) AS n FROM o GROUP BY b),
e AS (SELECT b, l_suppkey AS u, p_brand AS f, sum(l_quantity) AS v FROM lineitem JOIN part ON l_partkey = p_partkey JOIN o ON u = l_suppkey GROUP BY ALL),
g AS (SELECT o.b, o.u, f.f, coalesce(e.v, 0) AS v FROM o JOIN (SELECT DISTINCT b, f FROM e) f ON f.b = o.b LEFT JOIN e ON e.b = o.b AND e.u = o.u AND e.f = f.f),
m AS (SELECT b, f, CAST(count(*) AS DOUBLE) AS n, avg(v) AS mean, var_samp(v) AS var FROM g GROUP BY b, f),
l AS (SELECT *, log10(mean) AS x, log10(var) AS y, count(*) OVER (PARTITION BY b) AS k FROM m WHERE var > 0),
p AS (SELECT a.b, a.f, c.x - a.x AS d, c.y, row_number() OVER (PARTITION BY a.b, a.f ORDER BY abs(c.x - a.x)) AS i, greatest(floor({variable.SPAN} * a.k + 1e-9), 1) AS q FROM l a JOIN l c ON a.b = c.b),
r AS (SELECT *, max(abs(d)) OVER (PARTITION BY b, f) AS h FROM p WHERE i <= q),
t AS (SELECT b, f, d, y, power(greatest(1 - power(abs(d) / h, 3), 0), 3) AS w FROM r),
s AS (SELECT b, f, {sums} FROM t GROUP BY b, f),
z AS (SELECT m.*, sqrt(power(10, {det(*given)} / {det(*rows)})) AS dev FROM s JOIN m USING (b, f)),
score AS (SELECT g.b, g.f, sum(power((least(g.v, z.mean + z.dev * sqrt(z.n)) - z.mean) / z.dev, 2)) / (any_value(z.n) - 1) AS score FROM g JOIN z ON g.b = z.b AND g.f = z.f GROUP BY g.b, g.f),
k AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY round(score, 9) DESC, f) AS i FROM score),
v AS (SELECT f, avg(score) AS score, median(i) FILTER (i <= {top}) AS mid, count(*) FILTER (i <= {top}) AS n_batches FROM k GROUP BY f)
SELECT f AS feature_id, round(score, 6) AS score, n_batches, row_number() OVER (ORDER BY mid, n_batches DESC, f) AS place FROM v WHERE n_batches > 0 ORDER BY place LIMIT {top}"""


SQL = {
    "variable_counts": _variable_sql("'all'", 10),
    "variable_counts_by_batch": _variable_sql("s_suppkey % 3", 10),
    "knn": f"WITH {_NEAR} SELECT id, other, round(distance, 5) AS distance, place FROM n WHERE place <= 5",
    "knn_mixing": f"""WITH {_NEAR},
c AS (SELECT id, other_label, count(*) AS k FROM n WHERE place <= 10 GROUP BY id, other_label), h AS (SELECT id, -sum(k / 10.0::DOUBLE * ln(k / 10.0::DOUBLE)) AS h FROM c GROUP BY id),
o AS (SELECT -sum(k / n * ln(k / n)) AS h FROM (SELECT CAST(count(*) AS DOUBLE) AS k, CAST((SELECT count(*) FROM e) AS DOUBLE) AS n FROM e GROUP BY label) x)
SELECT round((SELECT avg(h) FROM h) / (SELECT h FROM o), 6) AS mixing""",
    "mean_silhouette": f"""WITH {_NEAR}, m AS (SELECT id, label, other_label, avg(distance) AS m FROM d GROUP BY id, label, other_label),
s AS (SELECT e.id, max(m) FILTER (m.label = other_label) AS a, min(m) FILTER (m.label <> other_label) AS b FROM e LEFT JOIN m ON e.id = m.id GROUP BY e.id)
SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM s""",
    "nearest_centroid": """WITH x AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM x GROUP BY label, i),
d AS (SELECT a.label AS a, b.label AS b, sqrt(sum(power(a.m - b.m, 2))) AS d FROM c a JOIN c b ON a.i = b.i AND a.label <> b.label GROUP BY a.label, b.label),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS k FROM d) SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM r WHERE k = 1""",
    "components_stranded": f"""WITH RECURSIVE {_NEAR}, g AS (SELECT id AS src, other AS dst FROM n WHERE place <= 2 UNION SELECT other, id FROM n WHERE place <= 2),
w AS (SELECT id, id AS seen FROM e UNION SELECT w.id, g.dst FROM w JOIN g ON w.seen = g.src) SELECT id, min(seen) AS component FROM w GROUP BY id""",
}
