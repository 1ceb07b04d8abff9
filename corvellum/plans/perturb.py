"""How far results stand when choices change: seeds, subsamples, number of features and components, resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvellum.operators import inference, matrix, sampling, structure
from corvellum.plans.sqlplan import apply

#: Changes that are tried unless others are given; each is one against the base.
SPECS = (
    {"name": "seed", "seed": 1},
    {"name": "fewer units", "share": 0.8},
    {"name": "fewer features", "features": 0.7},
    {"name": "fewer components", "components": 0.7},
    {"name": "coarser", "resolution": 0.7},
    {"name": "finer", "resolution": 1.4},
)


def _clusters(expr: DataFrame, n_features: int, n_components: int, resolution: float, k: int, seed: int) -> DataFrame:
    """Clusters of units (long ids) from the most variable features of ``expr`` (id, feature_id, value)."""
    n = expr.select("id").distinct().count()
    top = apply(matrix.variable_features(f"CAST({n} AS DOUBLE)", top=n_features), expr=expr.select(F.col("id").alias("unit_id"), "feature_id", "value"))
    order = [r.feature_id for r in top.orderBy("place").collect()]
    at = expr.sparkSession.createDataFrame([(f, i) for i, f in enumerate(order)], "feature_id string, i int")
    rows = expr.join(F.broadcast(at), "feature_id").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("i", "value"))).alias("m"))
    vec = structure.kept(rows.select("id", F.transform(F.sequence(F.lit(0), F.lit(len(order) - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("v")))
    scores, _, _ = structure.principal_components(vec, len(order), min(n_components, len(order)))
    graph = structure.shared_neighbour_graph(structure.nearest(structure.kept(scores.select("id", F.col("scores").alias("v"))), k))
    return structure.communities(graph, resolution, rounds=8, seed=seed)


def perturbed(expr: DataFrame, most: int = 5000, n_features: int = 200, n_components: int = 10, resolution: float = 1.0, k: int = 15, specs=SPECS) -> DataFrame:
    """(name, ari): agreement of the clusters under each change with those of the base, on the units they share.

    ``expr`` is (id, feature_id, value). At most ``most`` units, drawn by hashed order, are looked at: a stated limit of
    this check, as it does the whole analysis over for every change.
    """
    ids = sampling.capped(expr.select("id").distinct(), "id", most)
    base_expr = structure.kept(expr.join(ids, "id", "left_semi"))
    base = structure.kept(_clusters(base_expr, n_features, n_components, resolution, k, 0))
    out = []
    for spec in specs:
        part = base_expr if "share" not in spec else base_expr.where(F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(1000)) < int(1000 * spec["share"]))
        other = _clusters(part, int(n_features * spec.get("features", 1)), max(2, int(n_components * spec.get("components", 1))), resolution * spec.get("resolution", 1), k, spec.get("seed", 0))
        both = base.select("id", F.col("cluster").alias("a")).join(other.select("id", F.col("cluster").alias("b")), "id")
        out.append((spec["name"], apply(inference.adjusted_rand(), labels=both).first().ari))
    return expr.sparkSession.createDataFrame(out, "name string, ari double")


def robustness(agreement: DataFrame, robust: tuple[float, float] = (0.8, 0.6), sensitive: float = 0.6) -> DataFrame:
    """robust, sensitive or unstable, by the median and the least agreement."""
    a = agreement.agg(F.median("ari").alias("mid"), F.min("ari").alias("least"))
    return a.select("mid", "least", F.when((F.col("mid") >= robust[0]) & (F.col("least") >= robust[1]), "robust").when(F.col("mid") >= sensitive, "sensitive").otherwise("unstable").alias("verdict"))
