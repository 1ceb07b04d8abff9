"""Comparison of two conditions with samples as replicates, paired or not, over units and their values apart.

``{cells}`` has one row a unit (unit_id, sample, condition, batch, grp, ptype; batch, grp and ptype may be null), ``{values}`` only the
values that aren't zero (unit_id, feature, value). Cells are counted in the first and summed in the second, so a cell with many values
counts once and one without any counts too. ``{gate}`` is the row of `gate`: whether samples are paired decides, in one
rule for all that follows, which samples take part and how they are compared.
"""

from __future__ import annotations

from corvellum.functions.sqltext import num, rounded

#: Labels that are no type.
UNNAMED = ("ambiguous", "unassigned")
_NAMED = f"ptype IS NOT NULL AND ptype NOT IN {UNNAMED}"


def _count(condition: str) -> str:
    return f"count(CASE WHEN {condition} THEN 1 END)"


def gate(ref: str, test: str, min_cells: int = 10, min_units: int = 3, pure: float = 0.9) -> str:
    """One row about the design: cells and samples of each condition, whether all samples are in both, whether batches and groups hold one
    condition only, and a status of each. Samples count where they have ``min_cells`` cells or more; a sample that has fewer in
    one condition makes the whole design unpaired. Batches of one condition are a warning, not the end."""
    return f"""WITH o AS (SELECT * FROM {{cells}} WHERE condition IN ('{ref}', '{test}')),
u AS (SELECT sample, {_count(f"condition = '{ref}'")} AS a, {_count(f"condition = '{test}'")} AS b FROM o WHERE sample IS NOT NULL GROUP BY sample),
r AS (SELECT count(*) AS n_samples, {_count(f'a >= {min_cells}')} AS n_ref, {_count(f'b >= {min_cells}')} AS n_test, {_count(f'a >= {min_cells} AND b >= {min_cells}')} AS n_both FROM u),
k AS (SELECT batch, count(DISTINCT condition) AS k FROM o WHERE batch IS NOT NULL GROUP BY batch),
b AS (SELECT count(*) AS n_batches, {_count('k = 1')} AS n_single FROM k),
p AS (SELECT grp, greatest({_count(f"condition = '{ref}'")}, {_count(f"condition = '{test}'")}) / CAST(count(*) AS DOUBLE) AS top FROM o WHERE grp IS NOT NULL GROUP BY grp),
g AS (SELECT count(*) AS n_groups, {_count(f'top >= {num(pure)}')} AS n_pure FROM p),
t AS (SELECT {_count(f"condition = '{ref}'")} AS ref_cells, {_count(f"condition = '{test}'")} AS test_cells, {_count(f'NOT ({_NAMED})')} + {_count('ptype IS NULL')} AS n_unnamed FROM o),
e AS (SELECT count(*) AS n_cells FROM {{cells}})
SELECT ref_cells, test_cells, n_cells - ref_cells - test_cells AS n_left_out, n_samples, n_ref, n_test, n_both,
 CASE WHEN least(n_ref, n_test) < 2 THEN 'FAIL' WHEN least(n_ref, n_test) < {min_units} THEN 'WARN' ELSE 'PASS' END AS replicates,
 n_both >= {min_units} AND n_both = n_samples AS paired,
 CASE WHEN n_both >= {min_units} AND n_both = n_samples THEN 'PASS' WHEN n_both > 0 THEN 'WARN' ELSE 'INFO' END AS pairing,
 n_batches, n_single, CASE WHEN n_batches = 0 THEN 'INFO' WHEN n_single > 0 THEN 'WARN' ELSE 'PASS' END AS batch, n_batches > 0 AND n_single = n_batches AS confounded,
 n_groups, n_pure, CASE WHEN n_pure > {num(0.5)} * n_groups THEN 'WARN' ELSE 'PASS' END AS clusters,
 n_unnamed, CASE WHEN n_unnamed < {num(0.2)} * (ref_cells + test_cells) OR n_unnamed = 0 THEN 'INFO' ELSE 'WARN' END AS unlabelled
FROM r CROSS JOIN b CROSS JOIN g CROSS JOIN t CROSS JOIN e"""


def types(ref: str, test: str, min_cells: int = 10, min_units: int = 3, pure: float = 0.9) -> str:
    """Each named type: cells and samples with enough of them in each condition, pairs, whether it can be tested, and whether nearly all of
    its cells are of one condition."""
    return f"""WITH o AS (SELECT sample, condition, ptype FROM {{cells}} WHERE condition IN ('{ref}', '{test}') AND {_NAMED}),
s AS (SELECT ptype, sample, {_count(f"condition = '{ref}'")} AS a, {_count(f"condition = '{test}'")} AS b FROM o GROUP BY ptype, sample),
t AS (SELECT ptype, sum(a) AS ref_cells, sum(b) AS test_cells, {_count(f'a >= {min_cells}')} AS n_ref, {_count(f'b >= {min_cells}')} AS n_test, {_count(f'a >= {min_cells} AND b >= {min_cells}')} AS n_pairs FROM s GROUP BY ptype)
SELECT t.ptype, CAST(t.ref_cells AS BIGINT) AS ref_cells, CAST(t.test_cells AS BIGINT) AS test_cells, t.n_ref, t.n_test, t.n_pairs,
 CASE WHEN paired THEN t.n_pairs ELSE least(t.n_ref, t.n_test) END >= {min_units} AS testable,
 greatest(t.ref_cells, t.test_cells) >= {num(pure)} * (t.ref_cells + t.test_cells) AND t.ref_cells + t.test_cells >= {3 * min_cells} AS follows FROM t CROSS JOIN {{gate}} g"""


def kept_units(ref: str, test: str, min_cells: int = 10) -> str:
    """(ptype, sample, condition, n_cells) that are summed: enough cells, and in paired designs both conditions of the sample."""
    return f"""WITH u AS (SELECT ptype, sample, condition, count(*) AS n_cells FROM {{cells}} WHERE condition IN ('{ref}', '{test}') AND sample IS NOT NULL AND {_NAMED} GROUP BY ptype, sample, condition HAVING count(*) >= {min_cells}),
b AS (SELECT *, count(*) OVER (PARTITION BY ptype, sample) AS k FROM u)
SELECT b.ptype, b.sample, b.condition, b.n_cells FROM b CROSS JOIN {{gate}} g WHERE k = 2 OR NOT paired"""


def bulk(mean: bool = False) -> str:
    """Sums of each type, sample, condition and feature over ``{kept}``; means over all cells of the unit if ``mean``. Absent rows are zeros."""
    total = "sum(v.value) / max(k.n_cells)" if mean else "sum(v.value)"
    return f"""SELECT c.ptype, c.sample, c.condition, v.feature, {total} AS total FROM {{values}} v JOIN {{cells}} c ON v.unit_id = c.unit_id
JOIN {{kept}} k ON c.ptype = k.ptype AND c.sample = k.sample AND c.condition = k.condition GROUP BY c.ptype, c.sample, c.condition, v.feature"""


def tested_features(min_units: int = 3, min_total: float = 10.0) -> str:
    """(ptype, feature) with enough in ``{bulk}`` to be tested: a total, and units that have it."""
    return f"SELECT ptype, feature FROM {{bulk}} WHERE total > 0 GROUP BY ptype, feature HAVING sum(total) >= {num(min_total)} AND count(*) >= {min_units}"


def logs() -> str:
    """log2 of one plus counts per million of ``{bulk}``, of the features in ``{tested}``; zeros stay absent, as their log is zero."""
    return f"""WITH b AS (SELECT b.* FROM {{bulk}} b JOIN {{tested}} t ON b.ptype = t.ptype AND b.feature = t.feature)
SELECT ptype, sample, condition, feature, ln({num(1)} + total * {num(1e6)} / greatest(sum(total) OVER (PARTITION BY ptype, sample, condition), {num(1)})) / ln({num(2)}) AS v FROM b WHERE total > 0"""


def effects(ref: str, test: str) -> str:
    """Least squares of ``{logs}`` on condition, and on sample if the design is paired: (ptype, feature, n_ref, n_test, effect, t_stat, df).

    With samples in both conditions that is the t of the differences, otherwise the pooled t. An absent row is a zero, so
    sums and numbers of units are enough: no grid of units and features is made. The t is null where nothing is left over to judge by.
    """
    d = f"CASE WHEN condition = '{test}' THEN v ELSE -v END"
    side = lambda x, c: f"sum(CASE WHEN condition = '{c}' THEN {x} ELSE {num(0)} END)"
    return f"""WITH n AS (SELECT ptype, CAST({_count(f"condition = '{ref}'")} AS DOUBLE) AS n1, CAST({_count(f"condition = '{test}'")} AS DOUBLE) AS n2 FROM {{kept}} GROUP BY ptype),
d AS (SELECT ptype, feature, sample, sum({d}) AS d, {side('v', ref)} AS s1, {side('v', test)} AS s2, {side('v * v', ref)} AS q1, {side('v * v', test)} AS q2 FROM {{logs}} GROUP BY ptype, feature, sample),
f AS (SELECT ptype, feature, sum(d) AS d, sum(d * d) AS dd, sum(s1) AS s1, sum(s2) AS s2, sum(q1) AS q1, sum(q2) AS q2 FROM d GROUP BY ptype, feature),
x AS (SELECT f.ptype, feature, n1, n2, paired, s2 / nullif(n2, 0) - s1 / nullif(n1, 0) AS effect, CASE WHEN paired THEN n1 - 1 ELSE n1 + n2 - 2 END AS df,
 CASE WHEN paired THEN dd - d * d / n1 ELSE q1 - s1 * s1 / nullif(n1, 0) + q2 - s2 * s2 / nullif(n2, 0) END AS rss, CASE WHEN paired THEN dd ELSE q1 + q2 END AS whole FROM f JOIN n ON f.ptype = n.ptype CROSS JOIN {{gate}} g)
SELECT ptype, feature, CAST(n1 AS BIGINT) AS n_ref, CAST(n2 AS BIGINT) AS n_test, {rounded('effect')} AS effect,
 {rounded(f'''CASE WHEN df > 0 AND rss > {num(1e-12)} * whole THEN effect / sqrt(rss / df * CASE WHEN paired THEN {num(1)} / n1 ELSE {num(1)} / n1 + {num(1)} / n2 END) END''')} AS t_stat, CAST(df AS BIGINT) AS df FROM x WHERE n1 > 0 AND n2 > 0"""


def consistency(ref: str, test: str) -> str:
    """(ptype, consistency): among pairs of a paired design, the share whose difference has the sign of the effect, median over the features of
    ``{called}``(ptype, feature, effect); over ``{logs}`` and ``{kept}``. A pair with both values absent has no sign."""
    return f"""WITH n AS (SELECT ptype, CAST(count(DISTINCT sample) AS DOUBLE) AS n FROM {{kept}} GROUP BY ptype),
d AS (SELECT l.ptype, l.feature, l.sample, max(c.effect) AS effect, sum(CASE WHEN condition = '{test}' THEN v ELSE -v END) AS d FROM {{logs}} l JOIN {{called}} c ON l.ptype = c.ptype AND l.feature = c.feature GROUP BY l.ptype, l.feature, l.sample),
s AS (SELECT d.ptype, d.feature, count(CASE WHEN sign(d) = sign(effect) THEN 1 END) / max(n.n) AS agree FROM d JOIN n ON d.ptype = n.ptype CROSS JOIN {{gate}} g WHERE paired AND n.n >= 2 GROUP BY d.ptype, d.feature)
SELECT ptype, {rounded('median(agree)')} AS consistency FROM s GROUP BY ptype"""


def shares(ref: str, test: str, min_cells: int = 10, min_type_cells: int = 30) -> str:
    """Each named type of ``min_type_cells`` or more in each unit, those without it too: its cells k, all cells n of the unit (unnamed ones
    too), share and centred log ratio (of k + 0.5, over the types). Units as in `kept_units`, types together."""
    return f"""WITH o AS (SELECT sample, condition, ptype FROM {{cells}} WHERE condition IN ('{ref}', '{test}') AND sample IS NOT NULL),
u AS (SELECT sample, condition, count(*) AS n FROM o GROUP BY sample, condition HAVING count(*) >= {min_cells}),
b AS (SELECT *, count(*) OVER (PARTITION BY sample) AS both_of FROM u),
w AS (SELECT b.sample, b.condition, b.n FROM b CROSS JOIN {{gate}} g WHERE both_of = 2 OR NOT paired),
t AS (SELECT ptype FROM o WHERE {_NAMED} GROUP BY ptype HAVING count(*) >= {min_type_cells}),
c AS (SELECT sample, condition, ptype, count(*) AS k FROM o GROUP BY sample, condition, ptype),
x AS (SELECT w.sample, w.condition, t.ptype, coalesce(c.k, 0) AS k, w.n FROM w CROSS JOIN t LEFT JOIN c ON c.sample = w.sample AND c.condition = w.condition AND c.ptype = t.ptype)
SELECT sample, condition, ptype, k, n, k / CAST(n AS DOUBLE) AS share, ln(k + {num(0.5)}) - avg(ln(k + {num(0.5)})) OVER (PARTITION BY sample, condition) AS clr FROM x"""


def share_effects(ref: str, test: str) -> str:
    """(ptype, share_ref, share_test, log2_ratio, clr_effect, clr_t, df) over ``{shares}``: mean shares, and `effects` of the log ratios."""
    inner = effects(ref, test).replace("{logs}", "(SELECT 'all' AS ptype, ptype AS feature, sample, condition, clr AS v FROM {shares})").replace("{kept}", "(SELECT DISTINCT 'all' AS ptype, sample, condition FROM {shares})")
    mean = lambda c: f"avg(CASE WHEN condition = '{c}' THEN share END)"
    return f"""WITH m AS (SELECT ptype, {mean(ref)} AS share_ref, {mean(test)} AS share_test FROM {{shares}} GROUP BY ptype),
e AS ({inner})
SELECT m.ptype, {rounded('share_ref')} AS share_ref, {rounded('share_test')} AS share_test, {rounded(f'ln((share_test + {num(1e-4)}) / (share_ref + {num(1e-4)})) / ln({num(2)})', 5)} AS log2_ratio, e.effect AS clr_effect, e.t_stat AS clr_t, e.df
FROM m JOIN e ON m.ptype = e.feature"""
