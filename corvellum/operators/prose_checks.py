"""Checkpoints that are told in words only: thresholds for intake, quality, normalisation, structure, plates and
screens. Each takes a named relation and gives rows of check, status and the figure it rests on."""

from __future__ import annotations

from corvellum.functions.sqltext import num, rounded


def _verdict(x: str, warn: str, fail: str = "false") -> str:
    return f"CASE WHEN {fail.replace('$', x)} THEN 'FAIL' WHEN {warn.replace('$', x)} THEN 'WARN' ELSE 'PASS' END"


def intake() -> str:
    """Missing values overall and in the worst sample, empty samples, negative values; over {grid}(unit_id, feature_id,
    value or null)."""
    share = f"avg(CASE WHEN value IS NULL THEN {num(1)} ELSE {num(0)} END)"
    return f"""WITH s AS (SELECT unit_id, {share} AS missing FROM {{grid}} GROUP BY unit_id), o AS (SELECT {share} AS missing, count(CASE WHEN value < 0 THEN 1 END) AS negative FROM {{grid}})
SELECT 'missing overall' AS check_name, {_verdict('missing', f'$ > {num(0.3)}')} AS status, {rounded('missing')} AS figure FROM o
UNION ALL SELECT 'missing in a sample', {_verdict('max(missing)', f'$ > {num(0.5)}')}, {rounded('max(missing)')} FROM s
UNION ALL SELECT 'empty samples', {_verdict(f'count(CASE WHEN missing = {num(1)} THEN 1 END)', 'false', '$ > 0')}, CAST(count(CASE WHEN missing = {num(1)} THEN 1 END) AS DOUBLE) FROM s
UNION ALL SELECT 'impossible values', {_verdict('negative', 'false', '$ > 0')}, CAST(negative AS DOUBLE) FROM o"""


def quality_flags() -> str:
    """Samples far from the median total, or with few features; share flagged; over {samples}(sample, total, seen, mid)."""
    return f"""WITH a AS (SELECT median(total) AS mt, median(seen) AS ms FROM {{samples}}),
f AS (SELECT s.total < {num(0.2)} * a.mt OR s.total > {num(5)} * a.mt AS depth, s.seen < {num(0.4)} * a.ms AS few FROM {{samples}} s CROSS JOIN a),
g AS (SELECT avg(CASE WHEN depth THEN {num(1)} ELSE {num(0)} END) AS d, avg(CASE WHEN few THEN {num(1)} ELSE {num(0)} END) AS w FROM f)
SELECT 'depth' AS check_name, {_verdict('d', '$ > 0', f'$ > {num(0.3)}')} AS status, {rounded('d')} AS figure FROM g UNION ALL SELECT 'features seen', {_verdict('w', '$ > 0')}, {rounded('w')} FROM g"""


def size_factors() -> str:
    """Median-of-ratios size factor of each unit against the geometric mean of features seen everywhere; over {expr}
    with positive values, and {units}."""
    return f"""WITH f AS (SELECT feature_id, avg(ln(value)) AS g FROM {{expr}} WHERE value > 0 GROUP BY feature_id HAVING count(*) = (SELECT count(*) FROM {{units}}))
SELECT e.unit_id, {rounded('exp(median(ln(e.value) - f.g))')} AS factor FROM {{expr}} e JOIN f ON e.feature_id = f.feature_id WHERE e.value > 0 GROUP BY e.unit_id"""


def quantile_normalised() -> str:
    """Values of a complete {grid} replaced by the mean over units of the values of their rank."""
    return f"""WITH r AS (SELECT unit_id, feature_id, value, row_number() OVER (PARTITION BY unit_id ORDER BY value, feature_id) AS i FROM {{grid}}), m AS (SELECT i, avg(value) AS m FROM r GROUP BY i)
SELECT r.unit_id, r.feature_id, {rounded('m.m')} AS value FROM r JOIN m ON r.i = m.i"""


def percent_of_control(control: str) -> str:
    """Values of {wells}(plate, well, kind, value) in percent of their plate's control mean."""
    return f"WITH c AS (SELECT plate, avg(value) AS c FROM {{wells}} WHERE kind = '{control}' GROUP BY plate) SELECT w.plate, w.well, {rounded(f'{num(100)} * w.value / nullif(c.c, {num(0)})')} AS percent FROM {{wells}} w JOIN c ON w.plate = c.plate"


def z_prime(positive: str, negative: str) -> str:
    """Z-prime of each plate of {wells}, and whether it's at least one half."""
    part = lambda k, f: f"{f}(CASE WHEN kind = '{k}' THEN value END)"
    z = f"{num(1)} - {num(3)} * ({part(positive, 'stddev_samp')} + {part(negative, 'stddev_samp')}) / nullif(abs({part(positive, 'avg')} - {part(negative, 'avg')}), {num(0)})"
    return f"SELECT plate, {rounded(z)} AS z_prime, {z} >= {num(0.5)} AS good FROM {{wells}} GROUP BY plate"


def b_scores() -> str:
    """One step of median polish within each plate of {grid}(plate, r, c, value): residuals over 1.4826 MAD."""
    return f"""WITH a AS (SELECT plate, r, c, value - median(value) OVER (PARTITION BY plate, r) AS v FROM {{grid}}), b AS (SELECT plate, r, c, v - median(v) OVER (PARTITION BY plate, c) AS v FROM a),
m AS (SELECT plate, median(abs(v)) AS mad FROM b GROUP BY plate) SELECT b.plate, b.r, b.c, {rounded(f'b.v / greatest({num(1.4826)} * m.mad, {num(1e-12)})')} AS b_score FROM b JOIN m ON b.plate = m.plate"""


def edge_effect() -> str:
    """Difference of the mean of edge wells and inner ones, in deviations of the plate, over {grid}(plate, r, c, value)."""
    return f"""WITH e AS (SELECT plate, max(r) AS mr, max(c) AS mc, min(r) AS lr, min(c) AS lc, stddev_samp(value) AS s FROM {{grid}} GROUP BY plate)
SELECT g.plate, {rounded(f'(avg(CASE WHEN g.r IN (e.lr, e.mr) OR g.c IN (e.lc, e.mc) THEN g.value END) - avg(CASE WHEN NOT (g.r IN (e.lr, e.mr) OR g.c IN (e.lc, e.mc)) THEN g.value END)) / nullif(max(e.s), {num(0)})')} AS edge FROM {{grid}} g JOIN e ON g.plate = e.plate GROUP BY g.plate"""


def guide_coverage(reads: int = 30, share: float = 0.9) -> str:
    """Share of guides with enough reads in each sample of {guides}(sample, guide, reads)."""
    s = f"avg(CASE WHEN reads > {reads} THEN {num(1)} ELSE {num(0)} END)"
    return f"SELECT sample, {rounded(s)} AS covered, CASE WHEN {s} > {num(share)} THEN 'PASS' ELSE 'WARN' END AS status FROM {{guides}} GROUP BY sample"


def names_usable() -> str:
    """Share of the names of {a}(id) that {b}(id) knows, whatever their case."""
    return f"WITH k AS (SELECT CASE WHEN y.id IS NULL THEN {num(0)} ELSE {num(1)} END AS known FROM (SELECT DISTINCT upper(id) AS id FROM {{a}}) x LEFT JOIN (SELECT DISTINCT upper(id) AS id FROM {{b}}) y ON x.id = y.id) SELECT {rounded('avg(known)')} AS share, {_verdict('avg(known)', f'$ < {num(0.5)}', f'$ = {num(0)}')} AS status FROM k"


def followers(share: float = 0.9, least: int = 30) -> str:
    """Groups of {rows}(grp, condition) that are nearly all of one condition."""
    return f"""WITH c AS (SELECT grp, condition, count(*) AS n FROM {{rows}} GROUP BY grp, condition), t AS (SELECT grp, condition, n, sum(n) OVER (PARTITION BY grp) AS size, row_number() OVER (PARTITION BY grp ORDER BY n DESC, condition) AS i FROM c)
SELECT grp, condition, {rounded('n / CAST(size AS DOUBLE)')} AS share FROM t WHERE i = 1 AND size >= {least} AND n / CAST(size AS DOUBLE) >= {num(share)}"""
