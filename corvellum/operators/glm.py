"""Generalised linear models for many features at once, by reweighted least squares.

Each feature has few observations (units: samples by condition) and few terms, so features are dealt out in blocks; a task holds
one block's counts as an array, all features of it take their steps together, each with its own small normal equations. A step
that makes a feature's likelihood worse is halved for that feature alone. What has converged stops moving.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvellum.operators.structure import kept as behind_checkpoint

ROUNDS, HALVINGS, CLOSE = 100, 12, 1e-10
#: Features of a block.
BLOCK = 256


def design(units: pd.DataFrame, test: str, paired: bool) -> np.ndarray:
    """Intercept, condition, and, if samples are paired, a column for each sample but the first, over (sample, condition)."""
    columns = [np.ones(len(units)), (units["condition"] == test).to_numpy(float)]
    if paired:
        columns += [(units["sample"] == s).to_numpy(float) for s in sorted(units["sample"].unique())[1:]]
    return np.column_stack(columns)


def solve(x: np.ndarray, start: np.ndarray, step, fit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients (features, terms), their covariance and whether each converged. ``step(eta)`` gives weights and working
    residuals, ``fit(eta)`` the deviance of each feature; ``start`` is the first linear predictor (features, units)."""
    ridge = 1e-10 * np.eye(x.shape[1])
    inverse = lambda w: np.linalg.pinv(np.einsum("up,fu,uq->fpq", x, w, x) + ridge, hermitian=True)
    beta = start @ np.linalg.pinv(x).T
    eta = beta @ x.T
    worst, done = fit(eta), np.zeros(len(eta), bool)
    for _ in range(ROUNDS):
        w, r = step(eta)
        move = np.einsum("fpq,uq,fu->fp", inverse(w), x, w * r)
        move[done] = 0
        for _ in range(HALVINGS):
            new = (beta + move) @ x.T
            value = fit(new)
            bad = ~(value <= worst + 1e-8 * (1 + np.abs(worst)))
            if not bad.any():
                break
            move[bad] /= 2
        else:
            move[bad] = 0
            new, value = (beta + move) @ x.T, fit((beta + move) @ x.T)
        beta, eta = beta + move, new
        done |= np.abs(worst - value) <= CLOSE * (1 + np.abs(value))
        worst = value
        if done.all():
            break
    return beta, inverse(step(eta)[0]), done


def _in_blocks(rows: DataFrame, key: list[str], schema: str, run) -> DataFrame:
    """``run(frame)`` over whole features (``key``), many of them in a task."""
    names = [c.split()[0] for c in schema.split(", ")]
    blocks = rows.withColumn("block", F.pmod(F.xxhash64(*key), F.lit(1 << 16)))
    return blocks.groupBy("block").applyInPandas(lambda f: run(f.drop(columns="block"))[names], schema)


def binomial(k: np.ndarray, n: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
    """Logistic regression of k of n (features, units): condition's coefficient and error, dispersion (Pearson, one at least), df."""
    cut = lambda eta: 1 / (1 + np.exp(-np.clip(eta, -30, 30)))

    def step(eta):
        p = cut(eta)
        w = np.maximum(n * p * (1 - p), 1e-12)
        return w, (k - n * p) / w

    def fit(eta):
        p = np.clip(cut(eta), 1e-15, 1 - 1e-15)
        return -2 * (k * np.log(p) + (n - k) * np.log1p(-p)).sum(1)

    share = (k + 0.5) / (n + 1)
    beta, cov, done = solve(x, np.log(share / (1 - share)), step, fit)
    p = cut(beta @ x.T)
    df = max(x.shape[0] - np.linalg.matrix_rank(x), 1)
    spread = np.maximum(((k - n * p) ** 2 / np.maximum(n * p * (1 - p), 1e-12)).sum(1) / df, 1.0)
    return {"effect": beta[:, 1], "error": np.sqrt(np.maximum(cov[:, 1, 1], 0)), "dispersion": spread, "df": np.full(len(k), df), "converged": done}


def quasi_binomial(shares: DataFrame, test: str, paired: bool) -> DataFrame:
    """(ptype, log_odds, odds_t, odds_df, dispersion, converged) over ``shares`` (sample, condition, ptype, k, n): logistic regression of a
    type's cells on condition, and on sample if the design is paired, errors widened by the dispersion.

    The units are those of the table, the same for all types. Types with no cells, or nothing else than theirs, in all units of a condition have
    no finite answer; they get the value at which the steps stopped and a wide error. An empty table gives no rows.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["ptype", "sample", "condition"])
        wide = f.pivot(index="ptype", columns=["sample", "condition"], values="k").fillna(0)
        units = wide.columns.to_frame(index=False)
        n = f.drop_duplicates(["sample", "condition"]).set_index(["sample", "condition"])["n"].loc[wide.columns].to_numpy(float)
        found = binomial(wide.to_numpy(float), n[None, :], design(units, test, paired))
        t = found["effect"] / np.maximum(found["error"] * np.sqrt(found["dispersion"]), 1e-300)
        return pd.DataFrame({"ptype": wide.index, "log_odds": found["effect"], "odds_t": t, "odds_df": found["df"], "dispersion": found["dispersion"], "converged": found["converged"]})

    return _in_blocks(shares.select("ptype", "sample", "condition", "k", "n"), ["ptype"], "ptype string, log_odds double, odds_t double, odds_df long, dispersion double, converged boolean", run)


# ---- negative binomial --------------------------------------------------------------------------------------------


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series at x + 8, which is exact to about 1e-13."""
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _nb_deviance(y: np.ndarray, mu: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Minus two log likelihoods, without what doesn't depend on ``mu`` or ``alpha``."""
    r = 1 / alpha
    return -2 * (_log_gamma(y + r) - _log_gamma(r) - r * np.log1p(alpha * mu) + y * (np.log(alpha * mu) - np.log1p(alpha * mu)))


def nb_fit(y: np.ndarray, size: np.ndarray, x: np.ndarray, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, covariance, means and convergence of counts (features, units) with size factors and a dispersion each."""
    offset, a = np.log(size)[None, :], alpha[:, None]
    mean = lambda eta: np.exp(np.clip(eta + offset, -30, 30))

    def step(eta):
        mu = mean(eta)
        return mu / (1 + a * mu), (y - mu) / mu

    start = np.log(y / size[None, :] + 0.1)
    beta, cov, done = solve(x, start, step, lambda eta: _nb_deviance(y, mean(eta), a).sum(1))
    return beta, cov, mean(beta @ x.T), done


#: Dispersions that are tried: steps of the log.
_GRID = np.exp(np.linspace(math.log(1e-8), math.log(50.0), 121))


def _dispersion(y: np.ndarray, mu: np.ndarray, x: np.ndarray, prior: np.ndarray | None = None, width: float = 1.0) -> np.ndarray:
    """Dispersion of each feature of greatest Cox-Reid adjusted likelihood, with a normal prior on its log if there is one; found on a grid and
    refined by a parabola through the best three."""
    scores = np.empty((len(_GRID), len(y)))
    for i, a in enumerate(_GRID):
        alpha = np.full((len(y), 1), a)
        w = mu / (1 + alpha * mu)
        adjust = np.linalg.slogdet(np.einsum("up,fu,uq->fpq", x, w, x) + 1e-10 * np.eye(x.shape[1]))[1]
        scores[i] = 0.5 * _nb_deviance(y, mu, alpha).sum(1) + 0.5 * adjust
        if prior is not None:
            scores[i] += (math.log(a) - np.log(prior)) ** 2 / (2 * width)
    best = np.clip(scores.argmin(0), 1, len(_GRID) - 2)
    j = np.arange(len(y))
    low, mid, high = scores[best - 1, j], scores[best, j], scores[best + 1, j]
    curve = low - 2 * mid + high
    shift = np.where(curve > 1e-12, np.clip(0.5 * (low - high) / np.where(curve > 1e-12, curve, 1), -1, 1), 0)
    edge = scores.argmin(0)
    step = math.log(_GRID[1] / _GRID[0])
    return np.where(edge == 0, _GRID[0], np.where(edge == len(_GRID) - 1, _GRID[-1], _GRID[best] * np.exp(step * shift)))


_NB = "ptype string, feature string, base_mean double, own double"


def negative_binomial(bulk: DataFrame, kept: DataFrame, ref: str, test: str, paired: bool) -> DataFrame:
    """(ptype, feature, base_mean, log2fc, stat, dispersion, converged): Wald test of condition in a negative-binomial model of the totals of
    samples, with a term for each sample if the design is paired.

    ``bulk`` (ptype, sample, condition, feature, total; zeros absent) holds the features to test, ``kept`` (ptype, sample, condition) the
    units. Size factors are medians of ratios to the features' geometric means where a feature is in all units, else ratios of
    totals. Dispersions are fitted alone, then a trend over the means (a / mean + b, by least squares that leaves out what lies far off),
    then again with the trend as prior, as wide as the spread around it beyond sampling; far outliers above keep their own.
    Features meet in blocks of `BLOCK`; the trend and its spread are a few numbers a type.
    """
    bulk, kept = behind_checkpoint(bulk), behind_checkpoint(kept)
    n = kept.groupBy("ptype").agg(F.count("*").alias("n_units"))
    totals = bulk.groupBy("ptype", "sample", "condition").agg(F.sum("total").alias("depth"))
    whole = bulk.where("total > 0").groupBy("ptype", "feature").agg(F.count("*").alias("k"), F.avg(F.log("total")).alias("g")).join(n, "ptype").where("k = n_units").select("ptype", "feature", "g")
    ratio = bulk.join(whole, ["ptype", "feature"]).groupBy("ptype", "sample", "condition").agg(F.exp(F.median(F.log("total") - F.col("g"))).alias("ratio"))
    middle = totals.groupBy("ptype").agg(F.exp(F.avg(F.log("depth"))).alias("middle"))
    size = kept.select("ptype", "sample", "condition").join(totals, ["ptype", "sample", "condition"]).join(middle, "ptype").join(ratio, ["ptype", "sample", "condition"], "left")
    size = size.select("ptype", "sample", "condition", F.coalesce("ratio", F.col("depth") / F.col("middle")).alias("size"))
    # every unit's size goes along with each feature: units are few
    each = size.groupBy("ptype").agg(F.array_sort(F.collect_list(F.struct("sample", "condition", "size"))).alias("units"))
    wide = bulk.groupBy("ptype", "feature").agg(F.collect_list(F.struct("sample", "condition", "total")).alias("seen")).withColumn("block", F.pmod(F.xxhash64("ptype", "feature"), F.ceil(F.count("*").over(_by_type()) / BLOCK)))

    def arrays(f: pd.DataFrame):
        units = pd.DataFrame([(u["sample"], u["condition"], u["size"]) for u in f["units"].iloc[0]], columns=["sample", "condition", "size"])
        at = {(s, c): i for i, (s, c) in enumerate(zip(units["sample"], units["condition"], strict=True))}
        y = np.zeros((len(f), len(units)))
        for i, seen in enumerate(f["seen"]):
            for v in seen:
                if (j := at.get((v["sample"], v["condition"]))) is not None:
                    y[i, j] = round(v["total"])
        return y, units["size"].to_numpy(float), design(units, test, paired)

    def alone(f: pd.DataFrame) -> pd.DataFrame:
        y, s, x = arrays(f)
        norm = y / s[None, :]
        rough = np.clip((norm.var(1, ddof=1) - norm.mean(1) * (1 / s).mean()) / np.maximum(norm.mean(1) ** 2, 1e-12), 1e-8, 10.0)
        mu = nb_fit(y, s, x, rough)[2]
        return pd.DataFrame({"ptype": f["ptype"], "feature": f["feature"], "base_mean": norm.mean(1), "own": _dispersion(y, mu, x)})

    rows = wide.join(each, "ptype")
    first = behind_checkpoint(rows.groupBy("ptype", "block").applyInPandas(alone, _NB))

    def trend(f: pd.DataFrame) -> pd.DataFrame:
        """Least squares of the dispersions on 1 / mean and a constant, relative errors, without what lies far off; spread of the logs."""
        use = f[(f["own"] > 1e-7) & (f["base_mean"] > 0)]
        a0 = a1 = 0.0
        keep = np.ones(len(use), bool)
        for _ in range(10):
            d, m = use["own"].to_numpy()[keep], use["base_mean"].to_numpy()[keep]
            if len(d) < 3:
                break
            fit = np.full(len(d), d.mean()) if a0 == a1 == 0 else a0 + a1 / m
            w = 1 / np.maximum(fit, 1e-8)
            z = np.column_stack([w, w / m])
            a0, a1 = np.maximum(np.linalg.lstsq(z, w * d, rcond=None)[0], (1e-8, 0.0))
            off = use["own"].to_numpy() / (a0 + a1 / use["base_mean"].to_numpy())
            keep = (off > 1e-4) & (off < 15)
        if a0 == a1 == 0:
            a0 = float(use["own"].median()) if len(use) else 0.1
        off = np.log(use["own"] / (a0 + a1 / use["base_mean"]))
        spread = float(np.median(np.abs(off - np.median(off))) * 1.4826) if len(use) else 1.0
        return pd.DataFrame({"ptype": [f["ptype"].iloc[0]], "a0": [float(a0)], "a1": [float(a1)], "spread": [spread]})

    # what the trend needs: means and dispersions of at most TREND features of each of some steps of the mean
    steps = first.withColumn("step", F.floor(F.log2(F.col("base_mean") + 1) * 4))
    some = steps.withColumn("i", F.row_number().over(_by_type("step").orderBy(F.xxhash64("feature"), "feature"))).where(F.col("i") <= TREND)
    trends = some.groupBy("ptype").applyInPandas(lambda f: trend(f), "ptype string, a0 double, a1 double, spread double")

    def shrunk(f: pd.DataFrame) -> pd.DataFrame:
        y, s, x = arrays(f)
        df = max(x.shape[0] - np.linalg.matrix_rank(x), 1)
        line, own = f["a0"].to_numpy() + f["a1"].to_numpy() / np.maximum(f["base_mean"].to_numpy(), 1e-12), f["own"].to_numpy()
        spread = float(f["spread"].iloc[0])
        # sampling alone spreads the log of a dispersion by about trigamma(df / 2)
        width = max(spread**2 - (2 / df + 2 / df**2), 0.25)
        mu = nb_fit(y, s, x, line)[2]
        alpha = _dispersion(y, mu, x, line, width)
        alpha = np.where(np.log(own) > np.log(line) + 2 * spread, own, alpha)
        beta, cov, _, done = nb_fit(y, s, x, alpha)
        se = np.sqrt(np.maximum(cov[:, 1, 1], 0))
        stat = np.divide(beta[:, 1], se, out=np.full(len(se), np.nan), where=se > 0)
        return pd.DataFrame({"ptype": f["ptype"], "feature": f["feature"], "base_mean": f["base_mean"], "log2fc": beta[:, 1] / math.log(2), "stat": stat, "dispersion": alpha, "converged": done})

    full = rows.join(first, ["ptype", "feature"]).join(trends, "ptype")
    schema = "ptype string, feature string, base_mean double, log2fc double, stat double, dispersion double, converged boolean"
    return full.groupBy("ptype", "block").applyInPandas(shrunk, schema)


#: Features of a step of the mean that the trend of dispersions is fitted to; steps are quarters of a doubling.
TREND = 500


def _by_type(*more: str):
    from pyspark.sql import Window

    return Window.partitionBy("ptype", *more)
