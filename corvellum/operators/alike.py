"""Samples that correlate almost perfectly, block by block."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvellum.operators.structure import _cartesian, kept

#: Numbers that a block of samples by features holds at most, and samples.
CELLS, MOST = 4_194_304, 1024


def _exact(x: np.ndarray, y: np.ndarray, in_x: np.ndarray, in_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shared features and correlation of the rows of x with those of y, by deviations from the means; nan is a null value,
    the masks say where a feature is. Without variance the correlation is nan."""
    both = in_x & in_y
    vx, vy = both & ~np.isnan(x), both & ~np.isnan(y)

    def deviation(v, at):
        n = at.sum(1)
        v = np.where(at, v, 0)
        return np.where(at, v - (v.sum(1) / np.maximum(n, 1))[:, None], 0), n

    (dx, nx), (dy, ny), xy = deviation(x, vx), deviation(y, vy), vx & vy
    (cx, n), (cy, _) = deviation(x, xy), deviation(y, xy)
    with np.errstate(all="ignore"):
        sd = np.sqrt((dx * dx).sum(1) / nx) * np.sqrt((dy * dy).sum(1) / ny)
        return both.sum(1), np.where(sd > 0, (cx * cy).sum(1) / n / sd, np.nan)


def _likely(x: np.ndarray, y: np.ndarray, in_x: np.ndarray, in_y: np.ndarray, min_shared: int, above: float) -> np.ndarray:
    """Pairs that can't be ruled out by products of matrices: with enough shared features, and a correlation that is near or
    above the bound, or can't be told (null values, hardly any variance)."""
    px, py = in_x.astype(float), in_y.astype(float)
    shared = px @ py.T
    enough = shared >= min_shared
    n = np.maximum(shared, 1)

    def centred(v, there):
        at = there & ~np.isnan(v)
        return np.where(at, v - (np.where(at, v, 0).sum(1) / np.maximum(at.sum(1), 1))[:, None], 0)

    cx, cy = centred(x, in_x), centred(y, in_y)
    mx, my, xx, yy = cx @ py.T / n, px @ cy.T / n, (cx * cx) @ py.T / n, px @ (cy * cy).T / n
    vx, vy = xx - mx * mx, yy - my * my
    odd_x, odd_y = (np.isnan(v) & there for v, there in ((x, in_x), (y, in_y)))
    scale_x, scale_y = ((np.where(there & ~np.isnan(v), v, 0) ** 2).max(1, initial=0) for v, there in ((x, in_x), (y, in_y)))
    unsure = odd_x.any(1)[:, None] | odd_y.any(1)[None, :] | (vx <= 1e-9 * scale_x[:, None]) | (vy <= 1e-9 * scale_y[None, :])
    with np.errstate(all="ignore"):
        r = (cx @ cy.T / n - mx * my) / np.sqrt(np.maximum(vx, 0) * np.maximum(vy, 0))
    return enough & (unsure | ~(r <= above - 1e-5))


def near_duplicates(long: DataFrame, min_shared: int = 100, above: float = 0.9999) -> DataFrame:
    """Pairs of samples of {long}(sample, feature, value), one row for each sample and feature, that correlate almost
    perfectly over enough shared features: a, b (a before b), shared, r. The rows of `inference.near_duplicate_columns`.

    All pairs of samples are looked at, a block of samples beside a block; only the pairs found leave a task. The work is
    quadratic in the samples.
    """
    kind = long.schema["sample"].dataType.simpleString()
    rows = long.where("sample IS NOT NULL AND feature IS NOT NULL").select("sample", F.col("feature").cast("string").alias("feature"), F.col("value").cast("double").alias("value"))
    size = rows.agg(F.count_distinct("sample").alias("samples"), F.count_distinct("feature").alias("features")).first()
    n = max(1, -(-size.samples // max(16, min(MOST, CELLS // max(size.features, 1)))))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        sample, names = pd.factorize(frame["sample"], sort=True)
        feature, features = pd.factorize(frame["feature"], sort=True)
        v, there = np.full((len(names), len(features)), np.nan), np.zeros((len(names), len(features)), bool)
        v[sample, feature], there[sample, feature] = frame["value"].to_numpy(float), True
        return pd.DataFrame({"b": frame["b"].iloc[:1], "samples": [list(names)], "features": [list(features)], "v": [v.tobytes()], "there": [there.tobytes()]})

    blocks = kept(rows.withColumn("b", F.pmod(F.xxhash64("sample"), F.lit(n))).groupBy("b").applyInPandas(pack, f"b long, samples array<{kind}>, features array<string>, v binary, there binary").repartition(n))

    def side(samples, features, v, there):
        shape = (len(samples), len(features))
        return np.array(samples), np.array(features, dtype=object), np.frombuffer(v, float).reshape(shape), np.frombuffer(there, bool).reshape(shape)

    def run(batches):
        for frame in batches:
            for row in frame.itertuples(index=False):
                names_x, fx, x, in_x = side(row.q_samples, row.q_features, row.q_v, row.q_there)
                names_y, fy, y, in_y = side(row.r_samples, row.r_features, row.r_v, row.r_there)
                _, i, j = np.intersect1d(fx, fy, return_indices=True)
                x, in_x, y, in_y = x[:, i], in_x[:, i], y[:, j], in_y[:, j]
                a, b = np.nonzero(_likely(x, y, in_x, in_y, min_shared, above))
                if row.q_b == row.r_b:
                    a, b = a[a < b], b[a < b]
                step = max(1, CELLS // 8 // max(len(i), 1))
                for at in range(0, len(a), step):
                    p, o = a[at : at + step], b[at : at + step]
                    shared, r = _exact(x[p], y[o], in_x[p], in_y[o])
                    p, o, shared, r = (z[(shared >= min_shared) & (r > above)] for z in (p, o, shared, r))
                    swap = names_x[p] > names_y[o]
                    yield pd.DataFrame({"a": np.where(swap, names_y[o], names_x[p]), "b": np.where(swap, names_x[p], names_y[o]), "shared": shared, "r": r})

    pairs = _cartesian(blocks, n).where("q_b <= r_b").mapInPandas(run, f"a {kind}, b {kind}, shared long, r double")
    return pairs.withColumn("r", F.round("r", 6))
