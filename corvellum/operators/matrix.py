"""Filters, checks and summaries of long matrices: {expr}(unit_id, feature_id, value) holds stored non-zeros only,
{obs}(unit_id, sample, ...) its units. Absent rows are zeros, so means divide by the number of units."""

from __future__ import annotations

from collections.abc import Iterable

from corvellum.functions.sqltext import clip, linear, num, rounded


def linear_sums(scale: str = "counts") -> str:
    """Sum of each unit on the linear scale, its largest feature's share of it."""
    v = linear("value", scale)
    return f"SELECT unit_id, {rounded(f'sum({v})')} AS total, {rounded(f'max({v}) / greatest(sum({v}), {num(1e-12)})')} AS top_share FROM {{expr}} GROUP BY unit_id"


def qc_metrics(special: str) -> str:
    """Features seen, total, and percent of the total in special features ({special} is a condition on feature_id)."""
    return f"""SELECT unit_id, count(CASE WHEN value <> 0 THEN 1 END) AS n_features, {rounded('sum(value)')} AS total,
 {rounded(f'{num(100)} * sum(CASE WHEN {special} THEN value ELSE {num(0)} END) / greatest(sum(value), {num(1e-12)})')} AS pct_special
FROM {{expr}} GROUP BY unit_id"""


def fail_masks(min_features: int, max_features: int, max_pct: float) -> str:
    """Masks of units that fail a limit, and whether they stay; over {metrics}."""
    return f"""SELECT unit_id, n_features < {min_features} AS too_few, n_features > {max_features} AS too_many, pct_special > {num(max_pct)} AS too_special,
 NOT (n_features < {min_features} OR n_features > {max_features} OR pct_special > {num(max_pct)}) AS keep FROM {{metrics}}"""


def filter_impact(worst: int = 3) -> str:
    """Units that each mask removes, all together, and the samples that lose the largest share; over {masks}, {obs}."""
    return f"""WITH m AS (SELECT k.*, o.sample FROM {{masks}} k JOIN {{obs}} o ON k.unit_id = o.unit_id),
s AS (SELECT sample, avg(CASE WHEN keep THEN {num(0)} ELSE {num(1)} END) AS lost FROM m GROUP BY sample),
r AS (SELECT sample, lost FROM s ORDER BY lost DESC, sample LIMIT {worst})
SELECT 'too_few' AS what, CAST(count(CASE WHEN too_few THEN 1 END) AS DOUBLE) AS removed FROM m
UNION ALL SELECT 'too_many', CAST(count(CASE WHEN too_many THEN 1 END) AS DOUBLE) FROM m
UNION ALL SELECT 'too_special', CAST(count(CASE WHEN too_special THEN 1 END) AS DOUBLE) FROM m
UNION ALL SELECT 'any', CAST(count(CASE WHEN NOT keep THEN 1 END) AS DOUBLE) FROM m
UNION ALL SELECT concat('sample ', CAST(sample AS STRING)), {rounded('lost')} FROM r"""


def seen_features(min_units: int) -> str:
    """Features above zero in at least so many units: also the background of an enrichment."""
    return f"SELECT feature_id, count(CASE WHEN value > 0 THEN 1 END) AS n_units FROM {{expr}} GROUP BY feature_id HAVING count(CASE WHEN value > 0 THEN 1 END) >= {min_units}"


def missing_members(expected: Iterable[str]) -> str:
    """Which of the expected features are absent from {features}(feature_id)."""
    rows = " UNION ALL ".join(f"SELECT '{x}' AS feature_id" for x in expected)
    return f"SELECT e.feature_id FROM ({rows}) e WHERE NOT EXISTS (SELECT 1 FROM {{features}} f WHERE f.feature_id = e.feature_id)"


def signal_present(min_share: float = 0.01) -> str:
    """Whether a percentage is above zero in enough units; its share, median and 95th percentile over {metrics}."""
    share = f"avg(CASE WHEN pct_special > 0 THEN {num(1)} ELSE {num(0)} END)"
    return f"SELECT CASE WHEN {share} < {num(min_share)} THEN 'WARN' ELSE 'PASS' END AS status, {rounded(share)} AS share, {rounded('median(pct_special)')} AS mid, {rounded('percentile(pct_special, 0.95)')} AS p95 FROM {{metrics}}"


def alignment() -> str:
    """Duplicates in either list of ids, ids in one only, and rows whose labels differ; over {a} and {b} (id, label)."""
    return """SELECT (SELECT count(*) - count(DISTINCT id) FROM {a}) AS dup_a, (SELECT count(*) - count(DISTINCT id) FROM {b}) AS dup_b,
 count(CASE WHEN y.id IS NULL THEN 1 END) AS only_a, count(CASE WHEN x.id IS NULL THEN 1 END) AS only_b, count(CASE WHEN x.label <> y.label THEN 1 END) AS label_differs
FROM (SELECT id, max(label) AS label FROM {a} GROUP BY id) x FULL OUTER JOIN (SELECT id, max(label) AS label FROM {b} GROUP BY id) y ON x.id = y.id"""


def order_checks() -> str:
    """Are the ids on a matrix's columns the right ones, in the right order? Over {a}(pos, id, label), label being read from
    the matrix file itself, and {b}(id, label): three named checks with status and figure. A header shifted by one column leaves
    the sets alike and differs only where labels change, so a single disagreement fails."""
    return """WITH d AS (SELECT count(*) - count(DISTINCT id) AS n FROM {a}),
s AS (SELECT count(CASE WHEN y.id IS NULL THEN 1 END) AS only_a, count(CASE WHEN x.id IS NULL THEN 1 END) AS only_b FROM (SELECT DISTINCT id FROM {a}) x FULL OUTER JOIN (SELECT DISTINCT id FROM {b}) y ON x.id = y.id),
o AS (SELECT count(*) AS n, count(a.label) AS labelled, count(CASE WHEN b.label IS NULL OR a.label <> b.label THEN 1 END) AS bad FROM {a} a LEFT JOIN (SELECT id, max(label) AS label FROM {b} GROUP BY id) b ON a.id = b.id)
SELECT 'unique cell IDs' AS check_name, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status, n AS figure FROM d
UNION ALL SELECT 'cell ID sets match metadata', CASE WHEN only_a + only_b = 0 THEN 'PASS' ELSE 'FAIL' END, only_a + only_b FROM s
UNION ALL SELECT 'column order vs metadata', CASE WHEN labelled = 0 THEN 'WARN' WHEN bad = 0 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN labelled > 0 THEN bad END FROM o"""


def expected_values() -> str:
    """Figures that were published against those found, over {figures}(name, observed, expected) as text; nothing is let
    pass that isn't equal, and a figure that wasn't found fails."""
    return "SELECT name, observed, expected, CASE WHEN observed = expected THEN 'PASS' ELSE 'FAIL' END AS status FROM {figures} WHERE expected IS NOT NULL"


# Patterns of genes that tell of technique rather than of cells, on lower-case names.
TECHNICAL = ("^mt-", "^rp[sl][0-9]", "^hb[ab]")


def selection_checks(n_top: int, n_batches: int = 0, most_technical: float = 0.1, most_rare: float = 0.1, most_low: float = 0.3, least_overlap: float = 0.5) -> str:
    """Are the chosen features informative? Over {selected}(feature_id), {stats}(feature_id, mean, detected share),
    {half_a} and {half_b}(feature_id) chosen from two halves of the units, and {batches}(feature_id, n) in how many
    batches each varies: named checks with status and figure. The last is left out without batches."""
    technical = " OR ".join(f"name RLIKE '{t}'" for t in TECHNICAL)
    share = lambda x: f"coalesce(avg(CASE WHEN {x} THEN {num(1)} ELSE {num(0)} END), {num(0)})"
    text = f"""WITH n AS (SELECT count(*) AS n, count(*) - count(DISTINCT feature_id) AS twice, {share(technical)} AS technical FROM (SELECT feature_id, lower(feature_id) AS name FROM {{selected}}) x),
low AS (SELECT percentile(CASE WHEN mean > 0 THEN mean END, 0.1) AS cut FROM {{stats}}),
r AS (SELECT {share(f'detected < {num(0.01)}')} AS rare, {share(f'mean <= coalesce(cut, {num(0)})')} AS low FROM {{selected}} s JOIN {{stats}} t ON s.feature_id = t.feature_id CROSS JOIN low),
h AS (SELECT count(CASE WHEN a.feature_id IS NOT NULL AND b.feature_id IS NOT NULL THEN 1 END) / CAST(greatest(count(*), 1) AS DOUBLE) AS j FROM (SELECT DISTINCT feature_id FROM {{half_a}}) a FULL OUTER JOIN (SELECT DISTINCT feature_id FROM {{half_b}}) b ON a.feature_id = b.feature_id)
SELECT 'HVG count' AS check_name, CASE WHEN n = 0 OR twice > 0 THEN 'FAIL' WHEN n = {n_top} THEN 'PASS' ELSE 'WARN' END AS status, CAST(n AS DOUBLE) AS figure FROM n
UNION ALL SELECT 'technical genes among HVGs', CASE WHEN technical <= {num(most_technical)} THEN 'PASS' ELSE 'WARN' END, {rounded('technical')} FROM n
UNION ALL SELECT 'low-detection HVGs', CASE WHEN rare <= {num(most_rare)} THEN 'PASS' ELSE 'WARN' END, {rounded('rare')} FROM r
UNION ALL SELECT 'mean expression coverage', CASE WHEN low <= {num(most_low)} THEN 'PASS' ELSE 'WARN' END, {rounded('low')} FROM r
UNION ALL SELECT 'HVG stability (two halves)', CASE WHEN j >= {num(least_overlap)} THEN 'PASS' ELSE 'WARN' END, {rounded('j')} FROM h"""
    if not n_batches:
        return text
    need = max(1, -(-n_batches // 2))
    return text + f""" UNION ALL SELECT 'batch robustness', CASE WHEN {share(f'b.n >= {need}')} >= {num(0.5)} THEN 'PASS' ELSE 'WARN' END, {rounded(share(f'b.n >= {need}'))} FROM {{selected}} s LEFT JOIN {{batches}} b ON s.feature_id = b.feature_id"""


def first_of_each() -> str:
    """Different ids of {rows}(pos, id) in the order in which they first occur: id and its place from 1 on."""
    from corvellum.functions.sqltext import ranked

    return f"WITH {ranked('(SELECT id, min(pos) AS pos FROM {rows} GROUP BY id)', 'pos', 'id')} SELECT id, i AS place FROM k"


def detect_scale() -> str:
    """Scale of {expr}, from all its values: negatives, whole numbers, size, and the median sum after undoing a log."""
    near = lambda x, m: f"{x} BETWEEN {num(0.8 * m)} AND {num(1.2 * m)}"
    return f"""WITH v AS (SELECT count(CASE WHEN value < 0 THEN 1 END) AS negative, count(CASE WHEN value <> floor(value) THEN 1 END) AS broken, max(value) AS top, count(CASE WHEN value IS NULL THEN 1 END) AS absent FROM {{expr}}),
u AS (SELECT unit_id, sum(value) AS s0, sum(power({num(2)}, least(value, {num(60)})) - {num(1)}) AS s2, sum(exp(least(value, {num(60)})) - {num(1)}) AS se FROM {{expr}} GROUP BY unit_id),
m AS (SELECT median(s0) AS m0, median(s2) AS m2, median(se) AS me FROM u)
SELECT CASE WHEN negative > 0 THEN 'scaled_or_unknown' WHEN broken = 0 THEN 'counts' WHEN top < 50 AND {near('m2', 1e6)} THEN 'log2tpm'
 WHEN top < 50 AND {near('me', 1e4)} THEN 'log1p_cp10k' WHEN {near('m0', 1e6)} THEN 'linear_tpm' ELSE 'scaled_or_unknown' END AS scale,
 negative, broken, absent, {rounded('top')} AS top FROM v CROSS JOIN m"""


def expected_counts() -> str:
    """Groups of {found}(k) whose number of rows isn't that of {expected}(k, n)."""
    return "SELECT coalesce(f.k, e.k) AS k, coalesce(f.n, 0) AS found, coalesce(e.n, 0) AS expected, CASE WHEN coalesce(f.n, 0) = coalesce(e.n, 0) THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT k, count(*) AS n FROM {found} GROUP BY k) f FULL OUTER JOIN {expected} e ON f.k = e.k"


def normalise(scale: str, target: float = 1e4) -> str:
    """Values as natural logs of one plus counts per ``target``, or logs of linear values; log scales stay as they are."""
    if scale == "counts":
        v = f"ln({num(1)} + value * {num(target)} / sum(value) OVER (PARTITION BY unit_id))"
    elif scale == "linear_tpm":
        v = f"ln({num(1)} + value)"
    elif scale in ("log2tpm", "log1p_cp10k"):
        v = "value"
    else:
        raise ValueError(f"{scale!r} can't be normalised")
    return f"SELECT unit_id, feature_id, value AS raw_value, {rounded(v)} AS value FROM {{expr}}"


def normalisation_checks(max_cv: float = 0.1, max_ratio: float = 5.0, dominant: float = 0.5) -> str:
    """Spread of unit totals, units with a dominant feature, ratio of sample depths; over {sums}(unit_id, total,
    top_share) and {obs}."""
    return f"""WITH d AS (SELECT o.sample, median(s.total) AS depth FROM {{sums}} s JOIN {{obs}} o ON s.unit_id = o.unit_id GROUP BY o.sample),
r AS (SELECT max(depth) / greatest(min(depth), {num(1e-12)}) AS ratio FROM d)
SELECT {rounded(f'stddev_pop(total) / greatest(avg(total), {num(1e-12)})')} AS cv, CASE WHEN stddev_pop(total) / greatest(avg(total), {num(1e-12)}) > {num(max_cv)} THEN 'WARN' ELSE 'PASS' END AS cv_status,
 {rounded(f'avg(CASE WHEN top_share > {num(dominant)} THEN {num(1)} ELSE {num(0)} END)')} AS dominated, {rounded('max(ratio)')} AS depth_ratio, CASE WHEN max(ratio) > {num(max_ratio)} THEN 'WARN' ELSE 'PASS' END AS depth_status
FROM {{sums}} CROSS JOIN r"""


def variable_features(n_units: str, bins: int = 20, top: int = 10) -> str:
    """Most variable features: dispersion (variance over mean of linear values) as a z-score within equal-width bins of
    the log mean; bins of one feature have the score 1. ``n_units`` is an expression for the number of units."""
    return f"""WITH f AS (SELECT feature_id, sum(value) / {n_units} AS mean, (sum(value * value) - sum(value) * sum(value) / {n_units}) / ({n_units} - 1) AS var FROM {{expr}} GROUP BY feature_id),
d AS (SELECT feature_id, ln({num(1)} + mean) AS m, ln(CASE WHEN var / greatest(mean, {num(1e-12)}) = 0 THEN NULL ELSE var / greatest(mean, {num(1e-12)}) END) AS disp FROM f),
e AS (SELECT min(m) AS lo, max(m) AS hi FROM d),
b AS (SELECT d.*, CAST(least(floor((m - lo) * {num(bins)} / greatest(hi - lo, {num(1e-12)})), {num(bins - 1)}) AS INT) AS bin FROM d CROSS JOIN e),
s AS (SELECT bin, count(*) AS n, avg(disp) AS mid, stddev_samp(disp) AS spread FROM b GROUP BY bin),
z AS (SELECT feature_id, b.bin, disp, CASE WHEN n = 1 THEN {num(1)} ELSE (disp - mid) / nullif(spread, {num(0)}) END AS z FROM b JOIN s ON b.bin = s.bin),
t AS (SELECT *, round(z, 9) AS zr FROM z ORDER BY zr DESC NULLS LAST, feature_id LIMIT {top}),
r AS (SELECT *, row_number() OVER (ORDER BY zr DESC NULLS LAST, feature_id) AS i FROM t)
SELECT feature_id, bin, {rounded('disp')} AS dispersion, {rounded('z')} AS score, CAST(i AS BIGINT) AS place FROM r"""


def detected_somewhere(min_share: float = 0.25) -> str:
    """Features seen in enough of the units of some group; over {expr} and {obs} with a column grp."""
    return f"""WITH n AS (SELECT grp, count(*) AS n FROM {{obs}} GROUP BY grp),
s AS (SELECT o.grp, e.feature_id, count(CASE WHEN e.value > 0 THEN 1 END) AS k FROM {{expr}} e JOIN {{obs}} o ON e.unit_id = o.unit_id GROUP BY o.grp, e.feature_id)
SELECT feature_id, {rounded(f'max(k / CAST(n AS DOUBLE))')} AS best_share FROM s JOIN n ON s.grp = n.grp GROUP BY feature_id HAVING max(k / CAST(n AS DOUBLE)) >= {num(min_share)}"""


def group_stats() -> str:
    """Mean value and share above zero of each group and feature, zeros included."""
    return f"""WITH n AS (SELECT grp, count(*) AS n FROM {{obs}} GROUP BY grp)
SELECT o.grp, e.feature_id, {rounded('sum(e.value) / max(n.n)')} AS mean, {rounded('count(CASE WHEN e.value > 0 THEN 1 END) / CAST(max(n.n) AS DOUBLE)')} AS detected
FROM {{expr}} e JOIN {{obs}} o ON e.unit_id = o.unit_id JOIN n ON o.grp = n.grp GROUP BY o.grp, e.feature_id"""


def rescaled() -> str:
    """Means of {stats} brought to 0..1 across groups, flat features being 0."""
    over = "OVER (PARTITION BY feature_id)"
    return f"SELECT grp, feature_id, detected, {rounded(f'coalesce((mean - min(mean) {over}) / nullif(max(mean) {over} - min(mean) {over}, {num(0)}), {num(0)})')} AS scaled FROM {{stats}}"


def z_scores(limit: float = 10.0) -> str:
    """Features of a complete grid {grid}(unit_id, feature_id, value) as clipped z-scores (sample deviation)."""
    over = "OVER (PARTITION BY feature_id)"
    return f"SELECT unit_id, feature_id, {rounded(clip(f'(value - avg(value) {over}) / nullif(stddev_samp(value) {over}, {num(0)})', -limit, limit))} AS z FROM {{grid}}"


def densified() -> str:
    """All units of {units} by all features of {features}, zeros filled in."""
    return f"SELECT u.unit_id, f.feature_id, coalesce(e.value, {num(0)}) AS value FROM {{units}} u CROSS JOIN {{features}} f LEFT JOIN {{expr}} e ON e.unit_id = u.unit_id AND e.feature_id = f.feature_id"


def robust_flags(low_total: float = 0.2, low_seen: float = 0.4, far: float = 4.0) -> str:
    """Samples with little signal, and outliers by the deviation of their median in units of 1.4826 MAD; over
    {samples}(sample, total, seen, mid)."""
    return f"""WITH a AS (SELECT median(total) AS mt, median(seen) AS ms, median(mid) AS mm FROM {{samples}}),
b AS (SELECT median(abs(s.mid - a.mm)) AS mad FROM {{samples}} s CROSS JOIN a)
SELECT s.sample, s.total < {num(low_total)} * a.mt OR s.seen < {num(low_seen)} * a.ms AS weak, {rounded(f'(s.mid - a.mm) / greatest({num(1.4826)} * b.mad, {num(1e-12)})')} AS z,
 abs(s.mid - a.mm) / greatest({num(1.4826)} * b.mad, {num(1e-12)}) > {num(far)} AS outlier FROM {{samples}} s CROSS JOIN a CROSS JOIN b"""


def present_and_filled(min_share: float = 0.7) -> str:
    """Features of {grid} (null: missing) seen in enough samples, gaps filled by the feature's mean."""
    return f"""WITH f AS (SELECT feature_id, avg(value) AS m FROM {{grid}} GROUP BY feature_id HAVING count(value) >= {num(min_share)} * count(*))
SELECT g.unit_id, g.feature_id, {rounded('coalesce(g.value, f.m)')} AS value, g.value IS NULL AS imputed FROM {{grid}} g JOIN f ON g.feature_id = f.feature_id"""


def median_centred() -> str:
    """Values of {grid} less their sample's median, plus the grand mean."""
    return f"""WITH m AS (SELECT unit_id, median(value) AS m FROM {{grid}} GROUP BY unit_id), g AS (SELECT avg(value) AS g FROM {{grid}})
SELECT x.unit_id, x.feature_id, {rounded('x.value - m.m + g.g')} AS value FROM {{grid}} x JOIN m ON x.unit_id = m.unit_id CROSS JOIN g"""


def unpivoted(columns: Iterable[str], key: str) -> str:
    """A wide table {wide} as long rows without zeros."""
    return " UNION ALL ".join(f"SELECT {key} AS unit_id, '{c}' AS feature_id, CAST({c} AS DOUBLE) AS value FROM {{wide}} WHERE {c} <> 0" for c in columns)
