"""Multiple testing, ranks, agreement and effect sizes over small result tables; each names its relation in braces."""

from __future__ import annotations

from corvellum.functions.sqltext import correlation, ln_factorial, num, ranked, rounded, tied_ranks


def multiplicity(by: str = "", alpha: float = 0.05) -> str:
    """Bonferroni, Holm and Benjamini-Hochberg of {p}(id, p[, by]), per group if ``by`` is given; null p are left out.

    The running maxima and minima go bin by bin, and over one row for each bin: what a bin passes on is its extreme.
    """
    keys = f"id, {by}" if by else "id"
    group, same = (f"{by}, ", f" AND w.{by} = d.{by}") if by else ("", "")
    part = f"PARTITION BY {by} " if by else ""
    down, up = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    given = f"(SELECT {keys}, CAST(p AS DOUBLE) AS p FROM {{p}} WHERE p IS NOT NULL)"
    return f"""WITH {ranked(given, 'p', 'id', by)},
w AS (SELECT {keys}, b, p, m, max(least((m - i + 1) * p, {num(1)})) OVER (PARTITION BY {group}b ORDER BY i {down}) AS h, min(p * m / i) OVER (PARTITION BY {group}b ORDER BY i DESC {down}) AS q FROM k),
d AS (SELECT {group}b, max(h) OVER ({part}ORDER BY b {up}) AS h, min(q) OVER ({part}ORDER BY b DESC {up}) AS q FROM (SELECT {group}b, max(h) AS h, min(q) AS q FROM w GROUP BY {group}b) c),
z AS (SELECT w.*, greatest(w.h, coalesce(d.h, w.h)) AS holm, least(w.q, coalesce(d.q, w.q)) AS bh FROM w JOIN d ON w.b = d.b{same})
SELECT {keys}, {rounded('p')} AS p, {rounded(f'least(p * m, {num(1)})')} AS bonferroni, {rounded('holm')} AS holm, {rounded(f'least(bh, {num(1)})')} AS bh, holm < {num(alpha)} AS holm_called, bh < {num(alpha)} AS bh_called FROM z"""


def p_curve(alpha: float = 0.05) -> str:
    """Significant p-values, those in the lower half, and counts just under and over the usual threshold, over {p}."""
    return f"""SELECT count(CASE WHEN p < {num(alpha)} THEN 1 END) AS significant, count(CASE WHEN p < {num(alpha / 2)} THEN 1 END) AS low_half,
 count(CASE WHEN p >= {num(0.04)} AND p < {num(0.05)} THEN 1 END) AS near, count(CASE WHEN p >= {num(0.03)} AND p < {num(0.04)} THEN 1 END) AS mid,
 {rounded(f'count(CASE WHEN p >= {num(0.04)} AND p < {num(0.05)} THEN 1 END) / CAST(nullif(count(CASE WHEN p >= {num(0.03)} AND p < {num(0.04)} THEN 1 END), 0) AS DOUBLE)')} AS ratio,
 CASE WHEN count(CASE WHEN p < {num(alpha)} THEN 1 END) < 10 THEN 'Not assessable' ELSE 'Assessable' END AS verdict FROM {{p}}"""


def auc() -> str:
    """Area under the ROC of {scored}(score, positive 0/1), from average ranks."""
    return f"""WITH {tied_ranks('{scored}', 'score', 'r', 's')}
SELECT {rounded(f'(sum(CASE WHEN positive = 1 THEN rk END) - count(CASE WHEN positive = 1 THEN 1 END) * (count(CASE WHEN positive = 1 THEN 1 END) + {num(1)}) / {num(2)}) / (count(CASE WHEN positive = 1 THEN 1 END) * CAST(count(CASE WHEN positive = 0 THEN 1 END) AS DOUBLE))')} AS auc FROM r"""


def mann_whitney() -> str:
    """U, its z with tie and continuity correction, over {scored}(score, positive 0/1)."""
    return f"""WITH {tied_ranks('{scored}', 'score', 'r', 's')},
t AS (SELECT sum(CAST(k AS DOUBLE) * k * k - k) AS ties FROM (SELECT count(*) AS k FROM {{scored}} GROUP BY score) x),
s AS (SELECT sum(CASE WHEN positive = 1 THEN rk END) AS r1, CAST(count(CASE WHEN positive = 1 THEN 1 END) AS DOUBLE) AS n1, CAST(count(CASE WHEN positive = 0 THEN 1 END) AS DOUBLE) AS n0 FROM r)
SELECT {rounded(f'r1 - n1 * (n1 + {num(1)}) / {num(2)}')} AS u,
 {rounded(f'(abs(r1 - n1 * (n1 + {num(1)}) / {num(2)} - n1 * n0 / {num(2)}) - {num(0.5)}) / sqrt(n1 * n0 / {num(12)} * (n1 + n0 + {num(1)} - ties / ((n1 + n0) * (n1 + n0 - {num(1)}))))')} AS z FROM s CROSS JOIN t"""


def correlations() -> str:
    """Pearson and Spearman correlation of {xy}(x, y). `ranks.correlations` has the same row in steps."""
    both = "(SELECT x AS u, y AS v FROM {xy} WHERE x IS NOT NULL AND y IS NOT NULL)"
    return f"""WITH {tied_ranks(both, 'u', 'ru', 'u')},
{tied_ranks('(SELECT u, v, rk AS ru FROM ru)', 'v', 'rv', 'v')}
{both_correlations('rv')}"""


def both_correlations(relation: str) -> str:
    """Pearson and Spearman correlation over rows (u, v) and their ranks (ru, rk)."""
    return f"SELECT {rounded(correlation('u', 'v'))} AS pearson, {rounded(correlation('ru', 'rk'))} AS spearman FROM {relation}"


def icc() -> str:
    """Intraclass correlation from one-way mean squares, design effect and effective number, over {rows}(cluster, value);
    null where there are too few clusters or values."""
    return f"""WITH g AS (SELECT cluster, CAST(count(*) AS DOUBLE) AS n, avg(value) AS m, sum(value * value) AS q FROM {{rows}} WHERE value IS NOT NULL GROUP BY cluster),
t AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m) / sum(n) AS gm, sum(n * n) AS n2, sum(q - n * m * m) AS ssw FROM g),
b AS (SELECT sum(g.n * (g.m - t.gm) * (g.m - t.gm)) AS ssb FROM g CROSS JOIN t),
v AS (SELECT t.n, t.k, ssb / nullif(k - 1, 0) AS msb, ssw / nullif(n - k, 0) AS msw, (n - n2 / nullif(n, 0)) / nullif(k - 1, 0) AS n0 FROM t CROSS JOIN b),
w AS (SELECT n, n / nullif(k, 0) AS size, (msb - msw) / nullif(msb + (n0 - {num(1)}) * msw, 0) AS icc FROM v)
SELECT {rounded('icc')} AS icc, {rounded(f'{num(1)} + (size - {num(1)}) * icc')} AS design_effect, {rounded(f'n / nullif({num(1)} + (size - {num(1)}) * icc, 0)')} AS effective_n FROM w"""


def welch(by: str = "grp") -> str:
    """Welch's t and degrees of freedom between the two groups 0 and 1 of {rows}(grp, value)."""
    return f"""WITH g AS (SELECT {by} AS g, CAST(count(value) AS DOUBLE) AS n, avg(value) AS m, var_samp(value) AS s FROM {{rows}} GROUP BY {by}),
w AS (SELECT b.m - a.m AS d, a.s / a.n AS va, b.s / b.n AS vb, a.n AS na, b.n AS nb FROM g a CROSS JOIN g b WHERE a.g = 0 AND b.g = 1)
SELECT {rounded('d / sqrt(va + vb)')} AS t_stat, {rounded('(va + vb) * (va + vb) / (va * va / (na - 1) + vb * vb / (nb - 1))')} AS df FROM w"""


def chi_square() -> str:
    """Chi-square of the contingency of {rows}(a, b), with Yates' correction for two by two."""
    return f"""WITH c AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS n FROM {{rows}} GROUP BY a, b),
ra AS (SELECT a, sum(n) AS n FROM c GROUP BY a), rb AS (SELECT b, sum(n) AS n FROM c GROUP BY b), t AS (SELECT sum(n) AS n FROM c),
k AS (SELECT (SELECT count(*) FROM ra) AS ka, (SELECT count(*) FROM rb) AS kb),
e AS (SELECT ra.n * rb.n / t.n AS e, coalesce(c.n, {num(0)}) AS o FROM ra CROSS JOIN rb CROSS JOIN t LEFT JOIN c ON c.a = ra.a AND c.b = rb.b)
SELECT {rounded(f'sum(power(CASE WHEN ka = 2 AND kb = 2 THEN greatest(abs(o - e) - {num(0.5)}, {num(0)}) ELSE abs(o - e) END, 2) / e)')} AS chi2, max((ka - 1) * (kb - 1)) AS df FROM e CROSS JOIN k"""


def missingness(columns: tuple[str, ...], by: str) -> str:
    """Missing values of text columns (null, blank or a token for it), overall and per group, over {rows}."""
    tokens = "'', 'NA', 'NaN', 'nan', 'NULL', 'null', 'N/A'"
    return " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({by} AS STRING) AS grp, count(*) AS n, count(CASE WHEN {c} IS NULL OR CAST({c} AS STRING) IN ({tokens}) THEN 1 END) AS missing, {rounded(f'''{num(100)} * avg(CASE WHEN {c} IS NULL OR CAST({c} AS STRING) IN ({tokens}) THEN {num(1)} ELSE {num(0)} END)''', 3)} AS percent FROM {{rows}} GROUP BY {by}" for c in columns)


def funnel(column: str) -> str:
    """Kept share and standardised mean difference between {eligible} and {analysed}."""
    return f"""SELECT e.n AS eligible, a.n AS analysed, {rounded(f'{num(100)} * a.n / nullif(e.n, 0)', 3)} AS kept_percent, {rounded('e.m')} AS mean_eligible, {rounded('a.m')} AS mean_analysed, {rounded('e.md')} AS median_eligible, {rounded('a.md')} AS median_analysed,
 {rounded(f'(a.m - e.m) / nullif(e.s, {num(0)})')} AS smd FROM (SELECT count(*) AS n, avg({column}) AS m, median({column}) AS md, stddev_samp({column}) AS s FROM {{eligible}}) e CROSS JOIN (SELECT count(*) AS n, avg({column}) AS m, median({column}) AS md FROM {{analysed}}) a"""


def eta_squared() -> str:
    """Share of the variance of each column of {rows}(grp, col, value) between groups, and the mean share weighted by
    variance, as column -1."""
    return f"""WITH g AS (SELECT col, grp, CAST(count(*) AS DOUBLE) AS n, avg(value) AS m, sum(value * value) AS q FROM {{rows}} GROUP BY col, grp),
t AS (SELECT col, sum(n) AS n, sum(n * m) / sum(n) AS gm, sum(q) AS q FROM g GROUP BY col),
r AS (SELECT g.col, sum(g.n * (g.m - t.gm) * (g.m - t.gm)) / greatest(max(t.q - t.n * t.gm * t.gm), {num(1e-12)}) AS r2, max(t.q - t.n * t.gm * t.gm) AS v FROM g JOIN t ON g.col = t.col GROUP BY g.col)
SELECT CAST(col AS BIGINT) AS col, {rounded('r2')} AS r2 FROM r UNION ALL SELECT CAST(-1 AS BIGINT), {rounded('sum(r2 * v) / sum(v)')} FROM r"""


def adjusted_rand() -> str:
    """Agreement of two labelings {labels}(a, b), corrected for chance."""
    pairs = lambda x: f"sum({x} * ({x} - {num(1)}) / {num(2)})"
    return f"""WITH c AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS n FROM {{labels}} GROUP BY a, b),
x AS (SELECT {pairs('n')} AS s FROM c), ra AS (SELECT {pairs('n')} AS s FROM (SELECT sum(n) AS n FROM c GROUP BY a) y), rb AS (SELECT {pairs('n')} AS s FROM (SELECT sum(n) AS n FROM c GROUP BY b) y), t AS (SELECT sum(n) * (sum(n) - {num(1)}) / {num(2)} AS s FROM c)
SELECT {rounded(f'(x.s - ra.s * rb.s / t.s) / nullif((ra.s + rb.s) / {num(2)} - ra.s * rb.s / t.s, {num(0)})')} AS ari FROM x CROSS JOIN ra CROSS JOIN rb CROSS JOIN t"""


def best_jaccard() -> str:
    """For each cluster a of {labels}(a, b), its best Jaccard overlap with a cluster b."""
    return f"""WITH c AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS n FROM {{labels}} GROUP BY a, b),
j AS (SELECT a, b, n / (sum(n) OVER (PARTITION BY a) + sum(n) OVER (PARTITION BY b) - n) AS j FROM c)
SELECT a, {rounded('max(j)')} AS jaccard FROM j GROUP BY a"""


def ranked_labels() -> str:
    """Labels renamed by size, the largest being 0, over {labels}(id, label)."""
    return "WITH c AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS place FROM {labels} GROUP BY label) SELECT l.id, CAST(c.place AS BIGINT) AS place FROM {labels} l JOIN c ON l.label = c.label"


def batch_dominance(share: float = 0.9, min_cells: int = 10) -> str:
    """Clusters that are mostly of one batch which isn't as common overall; over {rows}(cluster, batch)."""
    return f"""WITH c AS (SELECT cluster, batch, count(*) AS n FROM {{rows}} GROUP BY cluster, batch),
o AS (SELECT batch, count(*) / CAST((SELECT count(*) FROM {{rows}}) AS DOUBLE) AS overall FROM {{rows}} GROUP BY batch),
t AS (SELECT cluster, batch, n, sum(n) OVER (PARTITION BY cluster) AS size, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, batch) AS i FROM c)
SELECT t.cluster, t.batch AS top_batch, {rounded('t.n / CAST(t.size AS DOUBLE)')} AS share, t.n / CAST(t.size AS DOUBLE) >= {num(share)} AND o.overall < {num(share)} AS dominated FROM t JOIN o ON t.batch = o.batch WHERE i = 1 AND size >= {min_cells}"""


def majority_label(min_share: float = 0.5) -> str:
    """Most frequent label of each cluster of {rows}(cluster, label) and its share, if large enough."""
    return f"""WITH c AS (SELECT cluster, label, count(*) AS n FROM {{rows}} GROUP BY cluster, label),
t AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY cluster) AS DOUBLE) AS share, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, label) AS i FROM c)
SELECT cluster, CASE WHEN share >= {num(min_share)} THEN label END AS label, {rounded('share')} AS share FROM t WHERE i = 1"""


def hypergeometric_tail(least_k: str, size: str, drawn: str, total: str, k: str = "k") -> str:
    """One term of the upper tail: the chance of exactly ``k`` of a set of ``size`` among ``drawn`` of ``total``."""
    f = ln_factorial
    plus = f"{f(size)} + {f(f'({total} - {size})')} + {f(drawn)} + {f(f'({total} - {drawn})')}"
    minus = f"{f(k)} - {f(f'({size} - {k})')} - {f(f'({drawn} - {k})')} - {f(f'({total} - {size} - {drawn} + {k})')} - {f(total)}"
    return f"CASE WHEN {k} >= {least_k} AND {k} >= {drawn} + {size} - {total} THEN exp({plus} - {minus}) ELSE {num(0)} END"


def shared_results(alpha: float) -> str:
    """One row for each id that {a} and {b} (id, effect, padj) share, case apart: effects ea, eb and whether each calls it, ca, cb."""
    one = lambda r: f"(SELECT upper(id) AS id, min_by(effect, padj) AS effect, min(padj) AS padj FROM {{{r}}} GROUP BY upper(id))"
    return f"SELECT a.effect AS ea, b.effect AS eb, a.padj < {num(alpha)} AS ca, b.padj < {num(alpha)} AS cb FROM {one('a')} a JOIN {one('b')} b ON a.id = b.id"


def shared_counts(relation: str) -> str:
    """One row of counts, agreement of signs and correlation of ranks over rows (ea, eb, ca, cb, ra, rk)."""
    return f"""SELECT count(*) AS n, count(CASE WHEN ca THEN 1 END) AS na, count(CASE WHEN cb THEN 1 END) AS nb, count(CASE WHEN ca AND cb THEN 1 END) AS nab, count(CASE WHEN ca OR cb THEN 1 END) AS either,
 avg(CASE WHEN ca AND cb THEN CASE WHEN sign(ea) = sign(eb) THEN {num(1)} ELSE {num(0)} END END) AS same, {correlation('ra', 'rk')} AS rho FROM {relation}"""


def overlap_tail(relation: str) -> str:
    """The chance p of so many called in both, for each n, over rows (n, na, nb, nab, k) with every k from nab on."""
    return f"SELECT n, least(sum({hypergeometric_tail('nab', 'na', 'nb', 'n')}), {num(1)}) AS p FROM {relation} GROUP BY n"


def agreement(s: str, p: str, least: int) -> str:
    """The report of `concordance` from its counts and the chance of so many in common."""
    return f"""SELECT CASE WHEN s.n < {least} THEN 'not testable' ELSE 'tested' END AS status, s.n AS n_shared, CASE WHEN s.n >= {least} THEN na END AS sig_a, CASE WHEN s.n >= {least} THEN nb END AS sig_b, CASE WHEN s.n >= {least} THEN nab END AS overlap,
 CASE WHEN s.n >= {least} THEN CASE WHEN na > 0 AND nb > 0 THEN {rounded('p.p')} ELSE {num(1)} END END AS overlap_p, CASE WHEN s.n >= {least} THEN {rounded('nab / CAST(greatest(either, 1) AS DOUBLE)')} END AS jaccard,
 CASE WHEN s.n >= {least} THEN {rounded('same')} END AS same_direction, CASE WHEN s.n >= {least} THEN {rounded('rho')} END AS effect_correlation FROM {s} LEFT JOIN {p} ON p.n = s.n"""


def concordance(alpha: float = 0.05, least: int = 10) -> str:
    """Agreement of two results {a}, {b} (id, effect, padj) over the ids that both have, case apart; of rows that repeat
    an id the one with the smallest padj counts. Called in each and in both with the chance of so many, Jaccard, share of
    the ids called in both that move the same way, Spearman of the effects; not testable under ``least`` shared ids.
    One text reads its relations many times; `ranks.concordance` has the same row in steps."""
    return f"""WITH {tied_ranks(f'({shared_results(alpha)})', 'ea', 'ra', 'a')},
{tied_ranks('(SELECT ea, eb, ca, cb, rk AS ra FROM ra)', 'eb', 'rb', 'b')},
s AS ({shared_counts('rb')}),
t AS (SELECT s.*, explode(sequence(nab, least(na, nb))) AS k FROM s),
p AS ({overlap_tail('t')})
{agreement('s', 'p', least)}"""


def set_overlap() -> str:
    """Jaccard overlap of two selections {a}, {b} (id)."""
    return f"SELECT count(CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN 1 END) AS both, count(*) AS either, {rounded('count(CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN 1 END) / CAST(greatest(count(*), 1) AS DOUBLE)')} AS jaccard FROM (SELECT DISTINCT id FROM {{a}}) a FULL OUTER JOIN (SELECT DISTINCT id FROM {{b}}) b ON a.id = b.id"


def near_duplicate_columns(min_shared: int = 100, above: float = 0.9999) -> str:
    """Pairs of samples of {long}(sample, feature, value) that correlate almost perfectly over enough shared features."""
    return f"SELECT x.sample AS a, y.sample AS b, count(*) AS shared, {rounded(correlation('x.value', 'y.value'))} AS r FROM {{long}} x JOIN {{long}} y ON x.feature = y.feature AND x.sample < y.sample GROUP BY x.sample, y.sample HAVING count(*) >= {min_shared} AND {correlation('x.value', 'y.value')} > {num(above)}"


def gaps_broken(max_gap: float) -> str:
    """Points of {points}(series, x, y) with a blank point in the middle of every gap that is too wide."""
    return f"""WITH p AS (SELECT series, CAST(x AS DOUBLE) AS x, y, lag(CAST(x AS DOUBLE)) OVER (PARTITION BY series ORDER BY x, y) AS before FROM {{points}})
SELECT series, {rounded('x')} AS x, y FROM p UNION ALL SELECT series, {rounded(f'(x + before) / {num(2)}')}, NULL FROM p WHERE x - before > {num(max_gap)}"""


def reconciled_ids() -> str:
    """Ids of {a} and {b} (id): matched exactly, matched once case, space and '-' are evened out, or left over."""
    from corvellum.functions.sqltext import norm_text

    return f"""WITH x AS (SELECT DISTINCT id FROM {{a}}), y AS (SELECT DISTINCT id FROM {{b}}),
e AS (SELECT x.id FROM x JOIN y ON x.id = y.id),
xa AS (SELECT id, {norm_text('id')} AS k FROM x WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.id = x.id)),
yb AS (SELECT max(id) AS id, {norm_text('id')} AS k FROM y WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.id = y.id) GROUP BY {norm_text('id')})
SELECT id AS a, id AS b, 'exact' AS how FROM e UNION ALL SELECT xa.id, yb.id, CASE WHEN yb.id IS NULL THEN 'unmatched' ELSE 'normalised' END FROM xa LEFT JOIN yb ON xa.k = yb.k"""


def equal_bins(bins: int = 25) -> str:
    """Equal-frequency bin of each id of {rows}(id, value) by rank."""
    from corvellum.functions.sqltext import bin_of_rank

    return f"WITH {ranked('{rows}', 'value', 'id')} SELECT id, {bin_of_rank('i', 'm', bins)} AS bin FROM k"


def expectation_check(min_share: float = 0.8, alpha: float = 0.05) -> str:
    """Which of {rules}(name, feature, direction) hold in {result}(feature, effect, padj): met, not met or not testable.

    Up and down ask for a share of the features, case apart, to be called that way; a control ('none') is met only if not one of
    its features is called. Under two features that the result has, nothing can be said. Of rows that repeat a feature
    the one with the smallest padj counts.
    """
    hit = f"CASE WHEN t.padj < {num(alpha)} AND (r.direction = 'up' AND t.effect > 0 OR r.direction = 'down' AND t.effect < 0 OR r.direction = 'none') THEN 1 ELSE 0 END"
    return f"""WITH t AS (SELECT upper(feature) AS feature, min_by(effect, padj) AS effect, min(padj) AS padj FROM {{result}} GROUP BY upper(feature)),
j AS (SELECT r.name, r.direction, t.feature, CASE WHEN t.feature IS NOT NULL THEN {hit} END AS hit FROM {{rules}} r LEFT JOIN t ON upper(r.feature) = t.feature),
g AS (SELECT name, direction, count(*) AS listed, count(feature) AS present, sum(hit) AS hits FROM j GROUP BY name, direction)
SELECT name, listed, present, coalesce(hits, 0) AS hits, CASE WHEN present < 2 THEN 'not testable' WHEN direction = 'none' AND hits = 0 OR direction <> 'none' AND hits / CAST(present AS DOUBLE) >= {num(min_share)} THEN 'met' ELSE 'not met' END AS verdict FROM g"""
