"""Held-out classifiers and reference labels."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvellum.operators.inference import auc
from corvellum.plans.sqlplan import apply


def held_out_auc(rows: DataFrame, strength: float = 0.5) -> DataFrame:
    """(sample, auc) of a balanced logistic model trained without that sample, over ``rows`` (id, sample, y 0/1, v);
    samples are never split, scaling is learned on the training part, and a sample of one class has no AUC."""
    spark = rows.sparkSession
    data = rows.select("id", "sample", F.col("y").cast("double").alias("y"), array_to_vector("v").alias("raw")).persist()
    out = []
    for sample in sorted(r.sample for r in data.select("sample").distinct().collect()):
        train, test = data.where(F.col("sample") != sample), data.where(F.col("sample") == sample)
        n = {r.y: r.n for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
        if len(n) < 2:
            continue
        total = sum(n.values())
        weight = F.when(F.col("y") == 1, total / (2 * n[1.0])).otherwise(total / (2 * n[0.0]))
        scaler = StandardScaler(inputCol="raw", outputCol="x", withMean=True, withStd=True).fit(train)
        model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=1 / (strength * total), elasticNetParam=0.0, standardization=False, maxIter=100)
        scored = model.fit(scaler.transform(train).withColumn("w", weight)).transform(scaler.transform(test))
        scored = scored.select(F.round(vector_to_array("probability")[1], 12).alias("score"), F.col("y").cast("int").alias("positive"))
        out.append((sample, apply(auc(), scored=scored).first().auc))
    data.unpersist()
    return spark.createDataFrame(out, "sample string, auc double")


def state_verdict(aucs: DataFrame) -> DataFrame:
    """clear, weak or no difference of state, from held-out areas."""
    a = aucs.agg(F.avg("auc").alias("mean"), F.min("auc").alias("least"))
    return a.select("mean", "least", F.when((F.col("mean") >= 0.8) & (F.col("least") >= 0.65), "clear").when(F.col("mean") >= 0.65, "weak").otherwise("none").alias("verdict"))


def reference_labels(expr: DataFrame, reference: DataFrame, top: int = 500, min_units: int = 10) -> DataFrame:
    """(unit_id, label, r) of the reference label whose centroid a unit's values correlate with best by rank, over
    complete ``expr`` (unit_id, feature_id, value) and ``reference`` (unit_id, label, feature_id, value)."""
    big = reference.select("label", "unit_id").distinct().groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= min_units).select("label")
    c = reference.join(F.broadcast(big), "label").groupBy("label", F.upper("feature_id").alias("f")).agg(F.avg("value").alias("m"))
    shared = expr.select(F.upper("feature_id").alias("f")).distinct()
    best = c.join(shared, "f", "left_semi").groupBy("f").agg(F.var_pop("m").alias("v")).orderBy(F.desc("v"), "f").limit(top).select("f")
    c = c.join(F.broadcast(best), "f")
    x = expr.withColumn("f", F.upper("feature_id")).join(F.broadcast(best), "f")

    def ranked(df, by, value):
        w = Window.partitionBy(by)
        return df.withColumn("rk", F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(by, value)) - 1) / 2)

    j = ranked(x, "unit_id", "value").select("unit_id", "f", F.col("rk").alias("rx")).join(ranked(c, "label", "m").select("label", "f", F.col("rk").alias("rc")), "f")
    r = j.groupBy("unit_id", "label").agg(F.corr("rx", "rc").alias("r"))
    return r.groupBy("unit_id").agg(F.max_by("label", F.struct("r", "label")).alias("label"), F.max("r").alias("r"))


def matched_label(label: str, types: list[str], mapping: dict[str, str] | None = None) -> str | None:
    """The panel's type for a reference label: by the mapping, by name, or by either name within the other."""
    if mapping and label in mapping:
        return mapping[label]
    low = label.lower()
    return next((t for t in types if t.lower() == low), None) or next((t for t in types if t.lower() in low or low in t.lower()), None)


def signature_p(rows: DataFrame, n_perm: int = 200, seed: int = 0, min_cells: int = 10) -> DataFrame:
    """Area by which a unit's mean score tells two groups apart, and its p over relabelled units, over ``rows`` (unit, y
    0/1, score). Units of both groups or too few rows are refused or left out; two units a group are the least."""
    import numpy as np

    u = rows.groupBy("unit").agg(F.avg("score").alias("m"), F.min("y").alias("lo"), F.max("y").alias("hi"), F.count("*").alias("n")).collect()
    if any(r.lo != r.hi for r in u):
        raise ValueError("a unit is in both groups")
    kept = sorted((r.unit, r.m, r.lo) for r in u if r.n >= min_cells)
    m, y = np.array([k[1] for k in kept], float), np.array([k[2] for k in kept], int)
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        raise ValueError("two units a group are the least")

    def area(y):
        a, b = m[y == 1], m[y == 0]
        return ((a[:, None] > b).mean() + (a[:, None] == b).mean() / 2) if len(a) * len(b) else 0.5

    rng, own = np.random.default_rng(seed), area(y)
    null = [area(rng.permutation(y)) for _ in range(n_perm)]
    return rows.sparkSession.createDataFrame([(float(own), float((sum(x >= own for x in null) + 1) / (n_perm + 1)), len(kept))], "auc double, p double, units int")
