"""Variable features of counts: variance against its trend over the mean, by local regression, values clipped.

Of each feature the log variance is set against the log mean; local quadratics (nearest `SPAN` of the features, tricube
weights) give the variance that its mean lets expect. A second pass over the values takes the variance of standardised values, clipped at
the root of the number of units, which is the score. With batches all of that is done within each, and features are ordered by
their median rank among the best of each batch.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPAN, DEGREE = 0.3, 2
#: Points of a trend at most; more features than that are averaged over neighbours of like mean, so a trend's points have a bounded size.
POINTS = 50_000


def local_fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, at: np.ndarray, span: float = SPAN) -> np.ndarray:
    """Local quadratics of y on x at each of ``at``: the nearest ``span`` of the points, tricube weights times their own."""
    order = np.argsort(x, kind="stable")
    x, y, weight = x[order], y[order], weight[order]
    k = min(len(x), max(math.floor(span * len(x) + 1e-9), 1))
    out = np.empty(len(at))
    for i, a in enumerate(at):
        # the window of k nearest points slides over the sorted ones
        lo, hi = 0, len(x) - k
        while lo < hi:
            mid = (lo + hi) // 2
            if a - x[mid] > x[mid + k] - a:
                lo = mid + 1
            else:
                hi = mid
        d = x[lo : lo + k] - a
        reach = max(np.abs(d).max(), 1e-12)
        w = np.sqrt(weight[lo : lo + k] * np.maximum(1 - (np.abs(d) / reach) ** 3, 0) ** 3)
        out[i] = np.linalg.lstsq(np.vander(d, DEGREE + 1, increasing=True) * w[:, None], y[lo : lo + k] * w, rcond=1e-10)[0][0]
    return out


def moments(expr: DataFrame, obs: DataFrame) -> DataFrame:
    """(batch, feature_id, n, mean, var) of {expr}(unit_id, feature_id, value) over all units of a batch in {obs}(unit_id, batch);
    absent values are zeros."""
    size = obs.groupBy("batch").agg(F.count("*").cast("double").alias("n"))
    sums = expr.join(obs, "unit_id").groupBy("batch", "feature_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") ** 2).alias("q"))
    mean = F.col("s") / F.col("n")
    return sums.join(size, "batch").where("n > 1").select("batch", "feature_id", "n", mean.alias("mean"), ((F.col("q") - F.col("s") * mean) / (F.col("n") - 1)).alias("var"))


def expected_deviation(stats: DataFrame) -> DataFrame:
    """``stats`` of `moments`, of features that vary at all, with the deviation that the trend lets expect.

    A trend's points go along with each task that works some of its features out; there are `POINTS` of them at most.
    """
    logs = stats.where("var > 0 AND mean > 0").withColumns({"x": F.log10("mean"), "y": F.log10("var")})
    by_mean = Window.partitionBy("batch")
    bins = logs.withColumn("bin", F.ntile(POINTS).over(by_mean.orderBy("x", "feature_id")))
    points = bins.groupBy("batch", "bin").agg(F.avg("x").alias("px"), F.avg("y").alias("py"), F.count("*").cast("double").alias("pw"))
    table = points.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("px", "py", "pw"))).alias("points"))

    names = [*stats.columns, "dev"]

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        p = f["points"].iloc[0]
        x, y, w = (np.array([v[c] for v in p]) for c in ("px", "py", "pw"))
        return f.assign(dev=np.sqrt(10.0 ** local_fit(x, y, w, f["x"].to_numpy())))[names]

    parts = logs.withColumn("part", F.pmod(F.xxhash64("feature_id"), F.lit(64))).join(F.broadcast(table), "batch")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema.fields) + ", dev double"
    return parts.groupBy("batch", "part").applyInPandas(fit, schema)


def standardised_variance(expr: DataFrame, obs: DataFrame) -> DataFrame:
    """(batch, feature_id, score): variance of standardised, clipped values within each batch."""
    trend = expected_deviation(moments(expr, obs)).withColumn("clip", F.col("mean") + F.col("dev") * F.sqrt("n"))
    cut = F.least("value", "clip")
    sums = expr.join(obs, "unit_id").join(trend, ["batch", "feature_id"]).groupBy("batch", "feature_id", "n", "mean", "dev").agg(F.sum(cut).alias("s"), F.sum(cut * cut).alias("q"))
    score = (F.col("n") * F.col("mean") ** 2 + F.col("q") - 2 * F.col("s") * F.col("mean")) / ((F.col("n") - 1) * F.col("dev") ** 2)
    return sums.select("batch", "feature_id", score.alias("score"))


def variable_counts(expr: DataFrame, obs: DataFrame, top: int) -> DataFrame:
    """(feature_id, score, n_batches, place) of the ``top`` most variable features of counts, ``obs`` being (unit_id, batch).

    Within a batch features rank by score; ranks beyond ``top`` don't count. Features are ordered by the median of their ranks, then by
    the number of batches that have them among the best, then by name; ``score`` is the mean over batches. A batch of one
    unit has no variance and takes no part; nulls are no values. Fewer features that vary than asked for give fewer rows.
    """
    each = standardised_variance(expr.where("value IS NOT NULL"), obs).withColumn("s", F.round("score", 9))
    ranked = each.withColumn("i", F.row_number().over(Window.partitionBy("batch").orderBy(F.desc("s"), "feature_id")))
    best = F.when(F.col("i") <= top, F.col("i"))
    over = ranked.groupBy("feature_id").agg(F.avg("score").alias("score"), F.median(best).alias("mid"), F.count(best).alias("n_batches")).where("n_batches > 0")
    order = ["mid", F.desc("n_batches"), "feature_id"]
    first = over.orderBy(*order).limit(top)
    return first.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long")).select("feature_id", "score", "n_batches", "place")
