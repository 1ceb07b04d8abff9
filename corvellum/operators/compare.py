"""Replicate-aware comparison: units are (sample, condition) pairs with two conditions, ``ref`` and ``test``."""

from __future__ import annotations

from corvellum.functions.sqltext import num, rounded


def design_gate(ref: str, test: str, min_cells: int = 10, follows: float = 0.9) -> str:
    """One row of counts and verdicts over {cells}(sample, condition, batch, grp): replicates, pairing, confounding of
    batch with condition, and groups that follow the condition."""
    return f"""WITH u AS (SELECT sample, condition, min(batch) AS batch, count(*) AS n FROM {{cells}} GROUP BY sample, condition HAVING count(*) >= {min_cells}),
s AS (SELECT sample, count(*) AS k FROM u GROUP BY sample),
b AS (SELECT batch, count(DISTINCT condition) AS k FROM u GROUP BY batch),
g AS (SELECT grp, greatest(count(CASE WHEN condition = '{ref}' THEN 1 END), count(CASE WHEN condition = '{test}' THEN 1 END)) / CAST(count(*) AS DOUBLE) AS top FROM {{cells}} GROUP BY grp),
r AS (SELECT count(CASE WHEN condition = '{ref}' THEN 1 END) AS n_ref, count(CASE WHEN condition = '{test}' THEN 1 END) AS n_test FROM u),
p AS (SELECT count(*) AS n_samples, count(CASE WHEN k = 2 THEN 1 END) AS n_paired FROM s),
c AS (SELECT count(*) AS n_batches, count(CASE WHEN k = 1 THEN 1 END) AS n_single FROM b),
f AS (SELECT count(CASE WHEN top >= {num(follows)} THEN 1 END) AS n_followers FROM g)
SELECT n_ref, n_test, CASE WHEN least(n_ref, n_test) < 2 THEN 'FAIL' WHEN least(n_ref, n_test) < 3 THEN 'WARN' ELSE 'PASS' END AS replicates,
 n_paired = n_samples AND n_samples >= 3 AS paired, CASE WHEN n_batches > 1 AND n_single = n_batches THEN 'FAIL' ELSE 'PASS' END AS batch, n_followers
FROM r CROSS JOIN p CROSS JOIN c CROSS JOIN f"""


def pseudobulk(min_cells: int = 10) -> str:
    """Sums of each unit, type and feature over {cells}(sample, condition, ptype, feature, value), of units with enough
    cells in samples that have both conditions."""
    return f"""WITH r AS (SELECT ptype, sample, condition, feature, sum(value) AS total, count(*) AS n FROM {{cells}} GROUP BY ptype, sample, condition, feature),
u AS (SELECT ptype, sample, condition FROM r GROUP BY ptype, sample, condition HAVING sum(n) >= {min_cells}),
p AS (SELECT ptype, sample FROM u GROUP BY ptype, sample HAVING count(*) = 2)
SELECT r.ptype, r.sample, r.condition, r.feature, {rounded('r.total')} AS total FROM r JOIN u ON r.ptype = u.ptype AND r.sample = u.sample AND r.condition = u.condition JOIN p ON r.ptype = p.ptype AND r.sample = p.sample"""


def log_cpm() -> str:
    """log2 of one plus counts per million of the unit, over {bulk} of `pseudobulk`."""
    return f"SELECT ptype, sample, condition, feature, {rounded(f'ln({num(1)} + total * {num(1e6)} / greatest(sum(total) OVER (PARTITION BY ptype, sample, condition), {num(1)})) / ln({num(2)})')} AS v FROM {{bulk}}"


def paired_t(ref: str, test: str) -> str:
    """One-sample t of pair differences, per type and feature, over {logs}(ptype, sample, condition, feature, v)."""
    return f"""WITH d AS (SELECT ptype, feature, sample, sum(CASE WHEN condition = '{test}' THEN v ELSE -v END) AS d FROM {{logs}} WHERE condition IN ('{ref}', '{test}') GROUP BY ptype, feature, sample HAVING count(*) = 2)
SELECT ptype, feature, count(*) AS n_pairs, {rounded('avg(d)')} AS effect, {rounded(f'avg(d) / nullif(stddev_samp(d) / sqrt(CAST(count(*) AS DOUBLE)), {num(0)})')} AS t_stat, count(*) - 1 AS df FROM d GROUP BY ptype, feature HAVING count(*) >= 3"""


def pooled_t(ref: str, test: str) -> str:
    """Least squares on one two-level factor: the pooled t, per type and feature, over {logs}."""
    return f"""WITH g AS (SELECT ptype, feature, condition, count(*) AS n, avg(v) AS m, coalesce(var_samp(v), {num(0)}) AS s FROM {{logs}} GROUP BY ptype, feature, condition),
w AS (SELECT a.ptype, a.feature, a.n AS n1, b.n AS n2, b.m - a.m AS effect, ((a.n - 1) * a.s + (b.n - 1) * b.s) / nullif(a.n + b.n - 2, 0) AS pooled
 FROM g a JOIN g b ON a.ptype = b.ptype AND a.feature = b.feature WHERE a.condition = '{ref}' AND b.condition = '{test}')
SELECT ptype, feature, {rounded('effect')} AS effect, {rounded(f'effect / nullif(sqrt(pooled * ({num(1)} / n1 + {num(1)} / n2)), {num(0)})')} AS t_stat, n1 + n2 - 2 AS df FROM w WHERE n1 + n2 > 2"""


def direction_consistency(ref: str, test: str) -> str:
    """Share of pairs whose difference has the sign of the mean difference, per type: the median over features."""
    return f"""WITH d AS (SELECT ptype, feature, sample, sum(CASE WHEN condition = '{test}' THEN v ELSE -v END) AS d FROM {{logs}} GROUP BY ptype, feature, sample HAVING count(*) = 2),
m AS (SELECT ptype, feature, avg(d) AS m FROM d GROUP BY ptype, feature),
s AS (SELECT d.ptype, d.feature, avg(CASE WHEN sign(d.d) = sign(m.m) THEN {num(1)} ELSE {num(0)} END) AS agree FROM d JOIN m ON d.ptype = m.ptype AND d.feature = m.feature GROUP BY d.ptype, d.feature)
SELECT ptype, {rounded('median(agree)')} AS consistency, CASE WHEN median(agree) < {num(0.75)} THEN 'WARN' ELSE 'PASS' END AS status FROM s GROUP BY ptype"""


def type_shares() -> str:
    """Share of each type among the cells of a sample and condition, and its centred log ratio, over {cells}."""
    return f"""WITH k AS (SELECT sample, condition, ptype, count(*) AS k FROM {{cells}} GROUP BY sample, condition, ptype)
SELECT sample, condition, ptype, k, {rounded('k / CAST(sum(k) OVER (PARTITION BY sample, condition) AS DOUBLE)')} AS share,
 {rounded(f'ln(k + {num(0.5)}) - avg(ln(k + {num(0.5)})) OVER (PARTITION BY sample, condition)')} AS clr FROM k"""


def share_ratio(ref: str, test: str) -> str:
    """log2 ratio of a type's mean share between conditions, over {shares}."""
    return f"SELECT ptype, {rounded(f'''ln((avg(CASE WHEN condition = '{test}' THEN share END) + {num(1e-4)}) / (avg(CASE WHEN condition = '{ref}' THEN share END) + {num(1e-4)})) / ln({num(2)})''', 5)} AS log2_ratio FROM {{shares}} GROUP BY ptype"


def two_way_counts(a: str, b: str, levels: tuple[str, ...]) -> str:
    """Counts of {rows} by ``a``, one column for each level of ``b``."""
    return f"SELECT {a}, " + ", ".join(f"count(CASE WHEN {b} = '{x}' THEN 1 END) AS n_{x.lower().replace(' ', '_')}" for x in levels) + f" FROM {{rows}} GROUP BY {a}"


def abundance_logit(ref: str, test: str) -> str:
    """Binomial model of a type's share with one two-level factor: log odds difference, its error with overdispersion
    (Pearson, at least 1), and degrees of freedom; over {shares} with k."""
    return f"""WITH t AS (SELECT sample, condition, ptype, CAST(k AS DOUBLE) AS k, CAST(sum(k) OVER (PARTITION BY sample, condition) AS DOUBLE) AS n FROM {{shares}}),
g AS (SELECT ptype, condition, sum(k) AS k, sum(n) AS n FROM t GROUP BY ptype, condition),
x AS (SELECT t.ptype, sum((t.k - t.n * g.k / g.n) * (t.k - t.n * g.k / g.n) / greatest(t.n * g.k / g.n * ({num(1)} - g.k / g.n), {num(1e-12)})) AS chi, count(*) - 2 AS df FROM t JOIN g ON t.ptype = g.ptype AND t.condition = g.condition GROUP BY t.ptype),
w AS (SELECT a.ptype, ln(b.k / (b.n - b.k)) - ln(a.k / (a.n - a.k)) AS d, sqrt({num(1)} / a.k + {num(1)} / (a.n - a.k) + {num(1)} / b.k + {num(1)} / (b.n - b.k)) AS se
 FROM g a JOIN g b ON a.ptype = b.ptype WHERE a.condition = '{ref}' AND b.condition = '{test}' AND a.k > 0 AND b.k > 0 AND a.k < a.n AND b.k < b.n)
SELECT w.ptype, {rounded('w.d')} AS log_odds, {rounded(f'w.se * sqrt(greatest(x.chi / nullif(x.df, 0), {num(1)}))')} AS error, x.df FROM w JOIN x ON w.ptype = x.ptype"""


def nb_wald(ref: str, test: str) -> str:
    """Negative-binomial two-group test per type and feature over {bulk}: size factors from totals, a moment estimate of
    dispersion, log2 ratio of group means and Wald z. (Without shrinkage along a dispersion trend.)"""
    return f"""WITH u AS (SELECT ptype, sample, condition, sum(total) AS s FROM {{bulk}} GROUP BY ptype, sample, condition),
f AS (SELECT ptype, sample, condition, s / avg(s) OVER (PARTITION BY ptype) AS sf FROM u),
x AS (SELECT DISTINCT ptype, feature FROM {{bulk}}),
y AS (SELECT x.ptype, x.feature, f.condition, f.sf, coalesce(b.total, {num(0)}) AS y FROM x JOIN f ON x.ptype = f.ptype LEFT JOIN {{bulk}} b ON b.ptype = x.ptype AND b.feature = x.feature AND b.sample = f.sample AND b.condition = f.condition),
g AS (SELECT ptype, feature, condition, sum(y) / sum(sf) AS mu, count(*) AS n, var_samp(y / sf) AS v, avg({num(1)} / sf) AS inv FROM y GROUP BY ptype, feature, condition),
d AS (SELECT ptype, feature, greatest(sum((n - 1) * (v - mu * inv)) / greatest(sum((n - 1) * mu * mu), {num(1e-12)}), {num(1e-8)}) AS alpha FROM g GROUP BY ptype, feature),
w AS (SELECT y.ptype, y.feature, y.condition, max(g.mu) AS mu, sum(y.sf * g.mu / ({num(1)} + d.alpha * y.sf * g.mu)) AS info, max(d.alpha) AS alpha FROM y JOIN g ON y.ptype = g.ptype AND y.feature = g.feature AND y.condition = g.condition JOIN d ON y.ptype = d.ptype AND y.feature = d.feature GROUP BY y.ptype, y.feature, y.condition)
SELECT a.ptype, a.feature, {rounded(f'ln(b.mu / a.mu) / ln({num(2)})')} AS log2fc, {rounded('a.alpha')} AS dispersion, {rounded(f'ln(b.mu / a.mu) / sqrt({num(1)} / a.info + {num(1)} / b.info)')} AS z
FROM w a JOIN w b ON a.ptype = b.ptype AND a.feature = b.feature WHERE a.condition = '{ref}' AND b.condition = '{test}' AND a.mu > 0 AND b.mu > 0"""


def _rank_sums(versus: str) -> str:
    """CTEs that end in s(a, b, feature_id, n1, n0, rank_sum, m1, m0, seen): rank sums of group a among a and b, features
    that no unit of either has left out. ``versus`` is a relation (a, b) of groups, b null for all others.

    Absent values are zeros, which are counted, not written out: ranks come from the counts of different values of a feature.
    """
    return f"""n AS (SELECT v.a, v.b, count(CASE WHEN o.grp = v.a THEN 1 END) AS n1, count(CASE WHEN o.grp <> v.a THEN 1 END) AS n0 FROM {versus} v JOIN {{obs}} o ON o.grp = v.a OR v.b IS NULL OR o.grp = v.b GROUP BY v.a, v.b),
c AS (SELECT o.grp, e.feature_id, e.value, count(*) AS k FROM {{expr}} e JOIN {{obs}} o ON e.unit_id = o.unit_id WHERE e.value <> 0 GROUP BY o.grp, e.feature_id, e.value),
d AS (SELECT v.a, v.b, o.feature_id, o.value, sum(CASE WHEN o.grp = v.a THEN o.k ELSE 0 END) AS k1, sum(CASE WHEN o.grp <> v.a THEN o.k ELSE 0 END) AS k0 FROM c o JOIN {versus} v ON o.grp = v.a OR v.b IS NULL OR o.grp = v.b GROUP BY v.a, v.b, o.feature_id, o.value),
z AS (SELECT d.a, d.b, d.feature_id, {num(0)} AS value, n.n1 - sum(d.k1) AS k1, n.n0 - sum(d.k0) AS k0 FROM d JOIN n ON n.a = d.a AND coalesce(n.b, '') = coalesce(d.b, '') GROUP BY d.a, d.b, d.feature_id, n.n1, n.n0),
y AS (SELECT a, b, feature_id, CAST(value AS DOUBLE) AS value, CAST(k1 AS DOUBLE) AS k1, CAST(k0 AS DOUBLE) AS k0 FROM d UNION ALL SELECT a, b, feature_id, value, CAST(k1 AS DOUBLE), CAST(k0 AS DOUBLE) FROM z),
r AS (SELECT *, sum(k1 + k0) OVER (PARTITION BY a, b, feature_id ORDER BY value) - (k1 + k0) + (k1 + k0 + 1) / {num(2)} AS rk FROM y),
s AS (SELECT a, b, feature_id, sum(k1) AS n1, sum(k0) AS n0, sum(k1 * rk) AS rank_sum, sum(k1 * value) / nullif(sum(k1), {num(0)}) AS m1, sum(k0 * value) / nullif(sum(k0), {num(0)}) AS m0,
 sum(CASE WHEN value <> 0 THEN k1 ELSE {num(0)} END) / nullif(sum(k1), {num(0)}) AS seen FROM r GROUP BY a, b, feature_id)"""


def rank_sum_markers(top: int = 5) -> str:
    """Features that rank higher in a group than in the rest by the rank-sum z (no tie correction), the best first; over
    {expr}(unit_id, feature_id, value), absent values being zeros, and {obs} with a column grp."""
    return f"""WITH v AS (SELECT DISTINCT CAST(grp AS STRING) AS a, CAST(NULL AS STRING) AS b FROM {{obs}}),
{_rank_sums('v').replace('{obs}', '(SELECT unit_id, CAST(grp AS STRING) AS grp FROM {obs})')},
q AS (SELECT a AS grp, feature_id, round((rank_sum - n1 * (n1 + n0 + {num(1)}) / {num(2)}) / sqrt(n1 * n0 * (n1 + n0 + {num(1)}) / {num(12)}), 6) AS z FROM s WHERE n1 > 0 AND n0 > 0),
t AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY z DESC, feature_id) AS place FROM q)
SELECT grp, feature_id, z, CAST(place AS BIGINT) AS place FROM t WHERE place <= {top}"""


def group_differences() -> str:
    """Every feature between the groups of {pairs}(a, b; b null for all others): rank-sum z (no tie correction), log2 ratio of
    mean linear values from log1p values, and the share of a's units that have it. Over {expr} and {obs}(unit_id, grp string)."""
    fold = f"ln((exp(m1) - {num(1)} + {num(1e-9)}) / (exp(m0) - {num(1)} + {num(1e-9)})) / ln({num(2)})"
    return f"""WITH {_rank_sums('{pairs}')}
SELECT a, b, feature_id, (rank_sum - n1 * (n1 + n0 + {num(1)}) / {num(2)}) / sqrt(n1 * n0 * (n1 + n0 + {num(1)}) / {num(12)}) AS z, {fold} AS log2fc, seen FROM s WHERE n1 > 0 AND n0 > 0"""


def design_matrix(paired: bool) -> str:
    """The design of {units}(unit, sample, treated 0/1) in long form (unit, term, x): intercept, treatment, and, if the
    samples are paired, one column for each sample but the first. Zeros are left out."""
    text = f"SELECT unit, '(intercept)' AS term, {num(1)} AS x FROM {{units}} UNION ALL SELECT unit, 'treated', CAST(treated AS DOUBLE) FROM {{units}} WHERE treated <> 0"
    return text + f" UNION ALL SELECT unit, concat('sample ', sample), {num(1)} FROM {{units}} WHERE sample > (SELECT min(sample) FROM {{units}})" if paired else text


def least_squares(y, design, term: str = "treated", most_terms: int = 2000):
    """Ordinary least squares for all features at once: ``y`` (unit, feature, value, complete) on ``design`` (unit, term, x);
    (feature, effect, t_stat, df) of one term. Null t where nothing is left to judge it by.

    Only the terms' cross products, terms squared numbers, come to the driver to be inverted (so their number is
    bounded); products with the features are added where they lie.
    """
    import numpy as np
    from pyspark.sql import functions as F

    spark = y.sparkSession
    cross = design.alias("a").join(design.alias("b"), "unit").groupBy(F.col("a.term").alias("a"), F.col("b.term").alias("b")).agg(F.sum(F.col("a.x") * F.col("b.x")).alias("s"))
    names = sorted(r.term for r in design.select("term").distinct().limit(most_terms + 1).collect())
    if len(names) > most_terms or term not in names:
        raise ValueError(f"the design has no term {term!r}" if term not in names else f"the design has over {most_terms} terms")
    at = {t: i for i, t in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for r in cross.collect():
        m[at[r.a], at[r.b]] = r.s
    inverse, rank = np.linalg.pinv(m, hermitian=True), int(np.linalg.matrix_rank(m, hermitian=True))
    n = design.select("unit").distinct().count()
    rows = [(a, b, float(inverse[i, j])) for a, i in at.items() for b, j in at.items()]
    inv = F.broadcast(spark.createDataFrame(rows, "term string, other string, w double"))
    known = y.join(design.select("unit").distinct(), "unit", "left_semi")
    xy = known.join(design, "unit").groupBy("feature", "term").agg(F.sum(F.col("x") * F.col("value")).alias("xy")).persist()
    beta = xy.join(inv, "term").groupBy("feature", F.col("other").alias("term")).agg(F.sum(F.col("w") * F.col("xy")).alias("b"))
    fit = beta.join(xy, ["feature", "term"], "left").groupBy("feature").agg(F.sum(F.col("b") * F.coalesce("xy", F.lit(0.0))).alias("explained"), F.max(F.when(F.col("term") == term, F.col("b"))).alias("effect"))
    whole = known.groupBy("feature").agg(F.sum(F.col("value") ** 2).alias("yy"))
    own, df = float(inverse[at[term], at[term]]), n - rank
    rss = F.greatest(F.col("yy") - F.col("explained"), F.lit(0.0))
    # differences of sums of squares leave noise of their size where a fit is exact
    se = F.when(rss > 1e-12 * F.col("yy"), F.sqrt(rss / F.lit(float(max(df, 1))) * F.lit(own)))
    return fit.join(whole, "feature").select("feature", "effect", (F.col("effect") / se if df > 0 else F.lit(None).cast("double")).alias("t_stat"), F.lit(df).alias("df"))
