"""Set enrichment and marker scoring. {sets}(term, feature_id), {ranked}(feature_id, stat), {genes}(feature_id),
{background}(feature_id)."""

from __future__ import annotations

from corvellum.functions.sqltext import bin_of_rank, num, ranked, rounded
from corvellum.operators.inference import hypergeometric_tail, multiplicity

# Words and the pattern that mark a term as housekeeping or as a disease, and the flags they get.
HOUSEKEEPING = ("ribosome", "proteasome", "spliceosome", "oxidative phosphorylation", "aminoacyl", "rna polymerase", "translation", "protein processing in endoplasmic")
DISEASE = ("infection", "disease", "cancer", "carcinoma", "leukemia", "syndrome", "diabetes", "myocarditis", "virus", "hepatitis", "tuberculosis", "malaria", "asthma", "arthritis", "addiction")
DISEASE_NUMBER = r"\[(hsa|mmu|rno)05\d{3}\]"
HOUSEKEEPING_FLAG = "housekeeping machinery"
DISEASE_FLAG = "disease or infection name; may reflect generic genes"


def sets_in_background(low: int = 10, high: int = 500) -> str:
    """Sets cut to the background, if their size then lies in the range."""
    return f"WITH k AS (SELECT DISTINCT s.term, upper(s.feature_id) AS feature_id FROM {{sets}} s WHERE EXISTS (SELECT 1 FROM {{background}} b WHERE upper(b.feature_id) = upper(s.feature_id))), n AS (SELECT term FROM k GROUP BY term HAVING count(*) BETWEEN {low} AND {high}) SELECT k.term, k.feature_id FROM k JOIN n ON k.term = n.term"


def overlaps(min_overlap: int = 3) -> str:
    """Overlap of {genes} with each set, set size, sizes of list and background, and fold over chance."""
    return f"""WITH g AS (SELECT DISTINCT upper(x.feature_id) AS feature_id FROM {{genes}} x WHERE EXISTS (SELECT 1 FROM {{background}} b WHERE upper(b.feature_id) = upper(x.feature_id))),
k AS (SELECT (SELECT count(*) FROM g) AS n, (SELECT count(DISTINCT upper(feature_id)) FROM {{background}}) AS total)
SELECT s.term, count(g.feature_id) AS overlap, count(*) AS size, max(k.n) AS n, max(k.total) AS total,
 {rounded('(count(g.feature_id) / CAST(max(k.n) AS DOUBLE)) / (count(*) / CAST(max(k.total) AS DOUBLE))')} AS fold
FROM {{sets}} s LEFT JOIN g ON upper(s.feature_id) = g.feature_id CROSS JOIN k GROUP BY s.term HAVING count(g.feature_id) >= {min_overlap}"""


def hypergeometric() -> str:
    """Upper tail of each overlap of {overlaps} and BH over terms, the most significant first by place."""
    return f"""WITH t AS (SELECT o.*, explode(sequence(o.overlap, least(o.size, o.n))) AS k FROM {{overlaps}} o),
q AS (SELECT term AS id, overlap, size, fold, least(sum({hypergeometric_tail('overlap', 'size', 'n', 'total')}), {num(1)}) AS p FROM t GROUP BY term, overlap, size, fold),
f AS ({multiplicity().replace('{p}', '(SELECT id, round(p, 12) AS p FROM q)')})
SELECT q.id AS term, q.overlap, q.size, q.fold, {rounded('q.p')} AS p, f.bh AS fdr FROM q JOIN f ON q.id = f.id"""


def running_score(min_overlap: int = 10) -> str:
    """Enrichment score of each set along {ranked}: the running sum at its largest deviation from zero."""
    return f"""WITH {ranked('(SELECT upper(feature_id) AS feature_id, max(stat) AS stat, -max(stat) AS falling FROM {ranked} WHERE stat IS NOT NULL GROUP BY upper(feature_id))', 'falling', 'feature_id')},
r AS (SELECT feature_id, stat, i, m AS n FROM k),
g AS (SELECT s.term, count(*) AS k, sum(abs(r.stat)) AS w FROM {{sets}} s JOIN r ON r.feature_id = upper(s.feature_id) GROUP BY s.term HAVING count(*) >= {min_overlap}),
h AS (SELECT s.term, r.i, sum(abs(r.stat) / g.w) OVER (PARTITION BY s.term ORDER BY r.i) AS hit, row_number() OVER (PARTITION BY s.term ORDER BY r.i) AS j, abs(r.stat) / g.w AS step, g.k, r.n FROM {{sets}} s JOIN r ON r.feature_id = upper(s.feature_id) JOIN g ON g.term = s.term),
d AS (SELECT term, hit - (i - j) / CAST(n - k AS DOUBLE) AS here, hit - step - (i - j) / CAST(n - k AS DOUBLE) AS before FROM h)
SELECT term, {rounded('CASE WHEN max(here) >= -min(before) THEN max(here) ELSE min(before) END')} AS es FROM d GROUP BY term"""


def running_score_by(min_overlap: int = 10) -> str:
    """`running_score` within each group of {ranked}(grp, feature_id, stat), with the size of the overlap."""
    one = "(SELECT grp, upper(feature_id) AS feature_id, max(stat) AS stat, -max(stat) AS falling FROM {ranked} WHERE stat IS NOT NULL GROUP BY grp, upper(feature_id))"
    return f"""WITH {ranked(one, 'falling', 'feature_id', 'grp')},
r AS (SELECT grp, feature_id, stat, i, m AS n FROM k),
g AS (SELECT r.grp, s.term, count(*) AS k, sum(abs(r.stat)) AS w FROM {{sets}} s JOIN r ON r.feature_id = upper(s.feature_id) GROUP BY r.grp, s.term HAVING count(*) >= {min_overlap}),
h AS (SELECT g.grp, g.term, r.i, sum(abs(r.stat) / greatest(g.w, {num(1e-12)})) OVER (PARTITION BY g.grp, g.term ORDER BY r.i) AS hit, row_number() OVER (PARTITION BY g.grp, g.term ORDER BY r.i) AS j, abs(r.stat) / greatest(g.w, {num(1e-12)}) AS step, g.k, r.n FROM {{sets}} s JOIN r ON r.feature_id = upper(s.feature_id) JOIN g ON g.term = s.term AND g.grp = r.grp),
d AS (SELECT grp, term, k, n, hit - (i - j) / CAST(greatest(n - k, 1) AS DOUBLE) AS here, hit - step - (i - j) / CAST(greatest(n - k, 1) AS DOUBLE) AS before FROM h)
SELECT grp, term, k AS size, max(n) AS n, {rounded('CASE WHEN max(here) >= -min(before) THEN max(here) ELSE min(before) END')} AS es FROM d GROUP BY grp, term, k"""


def unit_expectations(min_diff: float = 0.25, z: float = 2.3263478740408408) -> str:
    """Known biology against the units. {rules}(expectation, kind, col, grp, against, direction, min_fraction, low, high),
    {wanted}(expectation, feature_id), {expr}(unit_id, feature_id, value), {obs}(unit_id, col, grp), {hits}(grp, term).

    gene_up asks for a share (0.6 unless given) of the listed features to be higher (or lower) in the group than in
    ``against`` or all others, by a difference of means and a one-sided rank-sum z (of 0.01); set_up does so for scores
    of sets that are given as features, by 0.4 of the difference; fraction_range for a share of the units; set_enriched
    for a significant term that holds the set's name. What can't be looked at is not testable. Absent values are zeros; ranks
    come from counts of distinct values, so no units are sorted.
    """
    need = f"CASE r.kind WHEN 'set_up' THEN {num(0.4 * min_diff)} ELSE {num(min_diff)} END"
    return f"""WITH o AS (SELECT DISTINCT unit_id, col, CAST(grp AS STRING) AS grp FROM {{obs}}),
size AS (SELECT r.expectation, count(o.unit_id) AS n, count(CASE WHEN o.grp = r.grp THEN 1 END) AS n1, count(CASE WHEN CASE WHEN coalesce(r.against, '') <> '' THEN o.grp = r.against ELSE o.grp <> r.grp END THEN 1 END) AS n0 FROM {{rules}} r LEFT JOIN o ON o.col = r.col GROUP BY r.expectation),
seen AS (SELECT DISTINCT upper(feature_id) AS f FROM {{expr}}),
w AS (SELECT DISTINCT w.expectation, upper(w.feature_id) AS f, CASE WHEN seen.f IS NULL THEN 0 ELSE 1 END AS here FROM {{wanted}} w LEFT JOIN seen ON seen.f = upper(w.feature_id)),
v AS (SELECT r.expectation, w.f, e.value, count(CASE WHEN o.grp = r.grp THEN 1 END) AS k1, count(CASE WHEN o.grp <> r.grp AND (coalesce(r.against, '') = '' OR o.grp = r.against) THEN 1 END) AS k0
 FROM {{rules}} r JOIN w ON w.expectation = r.expectation AND w.here = 1 JOIN {{expr}} e ON upper(e.feature_id) = w.f JOIN o ON o.unit_id = e.unit_id AND o.col = r.col WHERE r.kind IN ('gene_up', 'set_up') AND e.value <> 0 GROUP BY r.expectation, w.f, e.value),
z AS (SELECT w.expectation, w.f, {num(0)} AS value, s.n1 - coalesce(sum(v.k1), 0) AS k1, s.n0 - coalesce(sum(v.k0), 0) AS k0 FROM w JOIN size s ON s.expectation = w.expectation LEFT JOIN v ON v.expectation = w.expectation AND v.f = w.f WHERE w.here = 1 GROUP BY w.expectation, w.f, s.n1, s.n0),
a AS (SELECT expectation, f, value, CAST(k1 AS DOUBLE) AS k1, CAST(k0 AS DOUBLE) AS k0 FROM v UNION ALL SELECT expectation, f, value, CAST(k1 AS DOUBLE), CAST(k0 AS DOUBLE) FROM z),
c AS (SELECT *, sum(k0) OVER (PARTITION BY expectation, f ORDER BY value) - k0 AS under FROM a),
u AS (SELECT expectation, f, sum(k1) AS n1, sum(k0) AS n0, sum(k1 * value) / nullif(sum(k1), {num(0)}) - sum(k0 * value) / nullif(sum(k0), {num(0)}) AS d, sum(k1 * (under + k0 / {num(2)})) AS u, sum(power(k1 + k0, 3) - (k1 + k0)) AS ties FROM c GROUP BY expectation, f),
t AS (SELECT u.*, r.kind, CASE WHEN r.direction = 'down' THEN {num(-1)} ELSE {num(1)} END AS way, {need} AS need,
 sqrt(greatest(n1 * n0 / {num(12)} * (n1 + n0 + 1 - ties / greatest((n1 + n0) * (n1 + n0 - 1), {num(1)})), {num(1e-12)})) AS s FROM u JOIN {{rules}} r ON r.expectation = u.expectation),
g AS (SELECT expectation, count(*) AS present, count(CASE WHEN n1 > 2 AND n0 > 2 AND way * d >= need AND (way * (u - n1 * n0 / {num(2)}) - {num(0.5)}) / s > {num(z)} THEN 1 END) AS ok FROM t GROUP BY expectation),
h AS (SELECT r.expectation, count(x.term) AS any_for_group, count(CASE WHEN instr(lower(x.term), lower(w.f)) > 0 THEN 1 END) AS hit FROM {{rules}} r JOIN w ON w.expectation = r.expectation LEFT JOIN {{hits}} x ON CAST(x.grp AS STRING) = r.grp WHERE r.kind = 'set_enriched' GROUP BY r.expectation)
SELECT r.expectation, r.kind, coalesce(g.present, 0) AS present, coalesce(g.ok, h.hit, 0) AS ok, {rounded('s.n1 / CAST(nullif(s.n, 0) AS DOUBLE)')} AS unit_share,
 CASE WHEN s.n1 = 0 OR r.kind NOT IN ('gene_up', 'set_up', 'fraction_range', 'set_enriched') THEN 'not testable'
  WHEN r.kind = 'fraction_range' THEN CASE WHEN s.n1 / CAST(s.n AS DOUBLE) BETWEEN coalesce(r.low, {num(0)}) AND coalesce(r.high, {num(1)}) THEN 'met' ELSE 'not met' END
  WHEN r.kind = 'set_enriched' THEN CASE WHEN coalesce(h.any_for_group, 0) = 0 THEN 'not testable' WHEN h.hit > 0 THEN 'met' ELSE 'not met' END
  WHEN g.present IS NULL THEN 'not testable' WHEN g.ok / CAST(g.present AS DOUBLE) >= coalesce(r.min_fraction, {num(0.6)}) THEN 'met' ELSE 'not met' END AS status
FROM {{rules}} r JOIN size s ON s.expectation = r.expectation LEFT JOIN g ON g.expectation = r.expectation LEFT JOIN h ON h.expectation = r.expectation"""


def ranked_list() -> str:
    """Statistics of {result}(feature, stat) by upper-case feature, missing ones left out; of rows that repeat a feature
    the greatest counts."""
    return "SELECT upper(CAST(feature AS STRING)) AS feature_id, max(CAST(stat AS DOUBLE)) AS stat FROM {result} WHERE stat IS NOT NULL AND feature IS NOT NULL GROUP BY upper(CAST(feature AS STRING))"


def generic_terms() -> str:
    """A flag for terms of {terms}(term) that are probably generic: machinery of any cell, or the name or number of a
    disease; empty for others."""
    any_of = lambda ws: " OR ".join(f"lower(term) LIKE '%{w}%'" for w in ws)
    pattern = DISEASE_NUMBER.replace(r"\d{3}", r"\d\d\d").replace("\\", "\\\\")  # braces name relations here
    return f"SELECT term, CASE WHEN {any_of(HOUSEKEEPING)} THEN '{HOUSEKEEPING_FLAG}' WHEN {any_of(DISEASE)} OR term RLIKE '{pattern}' THEN '{DISEASE_FLAG}' ELSE '' END AS flag FROM {{terms}}"


def group_scores(top: int = 5, min_diff: float = 0.0) -> str:
    """Features of each group against the rest by (mean difference) over its error, zeros included, the best first;
    over {expr} and {obs} with a column grp."""
    return f"""WITH n AS (SELECT grp, CAST(count(*) AS DOUBLE) AS k FROM {{obs}} GROUP BY grp), t AS (SELECT sum(k) AS n FROM n),
s AS (SELECT o.grp, e.feature_id, sum(e.value) AS s, sum(e.value * e.value) AS q FROM {{expr}} e JOIN {{obs}} o ON e.unit_id = o.unit_id GROUP BY o.grp, e.feature_id),
a AS (SELECT feature_id, sum(s) AS s, sum(q) AS q FROM s GROUP BY feature_id),
d AS (SELECT s.grp, s.feature_id, s.s / n.k AS mi, (a.s - s.s) / (t.n - n.k) AS mo, greatest(s.q / n.k - power(s.s / n.k, 2), {num(1e-9)}) AS vi, greatest((a.q - s.q) / (t.n - n.k) - power((a.s - s.s) / (t.n - n.k), 2), {num(1e-9)}) AS vo, n.k, t.n FROM s JOIN a ON s.feature_id = a.feature_id JOIN n ON s.grp = n.grp CROSS JOIN t),
z AS (SELECT grp, feature_id, mi - mo AS diff, round((mi - mo) / sqrt(vi / k + vo / (n - k)), 6) AS score FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, feature_id) AS i FROM z WHERE diff >= {num(min_diff)})
SELECT grp, feature_id, {rounded('diff')} AS diff, score, CAST(i AS BIGINT) AS place FROM r WHERE i <= {top}"""


def set_scores(bins: int = 25) -> str:
    """Mean of each set in each unit minus that of all other features in the same bins of mean expression; over a
    complete {grid}(unit_id, feature_id, value) and {sets}."""
    return f"""WITH m AS (SELECT feature_id, avg(value) AS m FROM {{grid}} GROUP BY feature_id),
{ranked('(SELECT feature_id, m AS mean FROM m)', 'mean', 'feature_id')},
b AS (SELECT feature_id, {bin_of_rank('i', 'm', bins)} AS bin FROM k),
sb AS (SELECT DISTINCT s.term, b.bin FROM {{sets}} s JOIN b ON s.feature_id = b.feature_id),
y AS (SELECT sb.term, b.feature_id, CASE WHEN s.feature_id IS NULL THEN 0 ELSE 1 END AS inside FROM sb JOIN b ON b.bin = sb.bin LEFT JOIN {{sets}} s ON s.term = sb.term AND s.feature_id = b.feature_id)
SELECT y.term, g.unit_id, {rounded(f'avg(CASE WHEN inside = 1 THEN value END) - coalesce(avg(CASE WHEN inside = 0 THEN value END), {num(0)})')} AS score FROM y JOIN {{grid}} g ON g.feature_id = y.feature_id GROUP BY y.term, g.unit_id"""


def panel_scores() -> str:
    """Score of each group for each cell type: over {stats}(grp, feature_id, scaled, detected) and
    {panel}(cell_type, gene, sign). Genes never well detected are set aside; a type needs at least two of its
    positives, and three or all it has."""
    return f"""WITH best AS (SELECT upper(feature_id) AS gene, max(detected) AS top FROM {{stats}} GROUP BY upper(feature_id)),
g AS (SELECT DISTINCT cell_type, upper(trim(gene)) AS gene, sign FROM {{panel}}),
p AS (SELECT g.cell_type, g.gene, g.sign, best.top FROM g LEFT JOIN best ON best.gene = g.gene WHERE g.sign = '+' OR NOT EXISTS (SELECT 1 FROM g h WHERE h.cell_type = g.cell_type AND h.gene = g.gene AND h.sign = '+')),
u AS (SELECT cell_type, count(CASE WHEN sign = '+' THEN 1 END) AS given, count(CASE WHEN sign = '+' AND top >= {num(0.05)} THEN 1 END) AS usable FROM p GROUP BY cell_type),
j AS (SELECT s.grp, p.cell_type, p.sign, s.scaled, s.detected >= greatest(least({num(0.25)}, p.top / {num(2)}), {num(0.1)}) AS seen FROM p JOIN {{stats}} s ON upper(s.feature_id) = p.gene WHERE p.top >= {num(0.05)} OR p.sign = '-')
SELECT j.grp, j.cell_type, {rounded(f'CASE WHEN max(u.usable) >= 2 AND max(u.usable) >= least(3, max(u.given)) THEN avg(CASE WHEN sign = {chr(39)}+{chr(39)} THEN scaled END) ELSE {num(0)} END')} AS score,
 {rounded(f'CASE WHEN max(u.usable) >= 2 AND max(u.usable) >= least(3, max(u.given)) THEN avg(CASE WHEN sign = {chr(39)}+{chr(39)} THEN CASE WHEN seen THEN {num(1)} ELSE {num(0)} END END) ELSE {num(0)} END')} AS pos_detect,
 count(CASE WHEN sign = '-' AND scaled >= {num(0.5)} AND seen THEN 1 END) AS negatives_on FROM j JOIN u ON j.cell_type = u.cell_type GROUP BY j.grp, j.cell_type"""


def called_types(voted: bool = False) -> str:
    """The best type of each group of {scores}(grp, cell_type, score, pos_detect, negatives_on, n_cells) and how sure
    it is: confident, probable, ambiguous or unassigned. If ``voted``, a type that another method names in {votes}(grp, vote; null for
    none) and that isn't the best one takes a confident name down to probable and a probable one to ambiguous."""
    join, other = ("LEFT JOIN {votes} v ON b.grp = v.grp", "coalesce(v.vote <> b.cell_type, FALSE)") if voted else ("", "FALSE")
    return f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, cell_type) AS i FROM {{scores}} WHERE pos_detect >= {num(0.5)} AND score >= {num(0.3)}),
b AS (SELECT a.grp, a.cell_type, a.score - coalesce(c.score, {num(0)}) AS margin, a.negatives_on, a.n_cells FROM e a LEFT JOIN e c ON c.grp = a.grp AND c.i = 2 WHERE a.i = 1),
g AS (SELECT DISTINCT grp FROM {{scores}}),
s AS (SELECT b.grp, b.cell_type, b.n_cells, CASE WHEN b.margin < {num(0.05)} OR b.negatives_on > 0 THEN 0 WHEN b.margin >= {num(0.15)} THEN 2 ELSE 1 END - CASE WHEN {other} THEN 1 ELSE 0 END AS sure FROM b {join})
SELECT g.grp, CASE WHEN s.grp IS NULL THEN 'unassigned' WHEN sure <= 0 THEN 'ambiguous' ELSE s.cell_type END AS label,
 CASE WHEN s.grp IS NULL THEN 'unassigned' WHEN sure <= 0 THEN 'ambiguous' WHEN sure = 2 AND s.n_cells >= 10 THEN 'confident' ELSE 'probable' END AS tier FROM g LEFT JOIN s ON g.grp = s.grp"""


def program_usage(dominant: float = 0.5) -> str:
    """Mean usage of programs in each type of {usage}(unit_id, ptype, program, value), as shares of the type; the
    largest is dominant from a limit on."""
    return f"""WITH m AS (SELECT ptype, program, avg(value) AS m FROM {{usage}} GROUP BY ptype, program),
s AS (SELECT ptype, program, m / nullif(sum(m) OVER (PARTITION BY ptype), {num(0)}) AS share, row_number() OVER (PARTITION BY ptype ORDER BY m DESC, program) AS i FROM m)
SELECT ptype, program, {rounded('share')} AS share, share >= {num(dominant)} AS dominant FROM s WHERE i = 1"""


def shared_markers() -> str:
    """Markers of each group that the panel has for its called type, over {markers}(grp, gene), {panel}(cell_type, gene,
    sign) and {calls}(grp, label)."""
    return "SELECT c.grp, c.label, count(p.gene) AS n_shared FROM {calls} c LEFT JOIN {markers} m ON m.grp = c.grp LEFT JOIN {panel} p ON p.cell_type = c.label AND p.sign = '+' AND upper(p.gene) = upper(m.gene) GROUP BY c.grp, c.label"


def findings(alpha: float = 0.05) -> str:
    """One row per type of {result}(ptype, feature, effect, padj): how many features are called up and down, the
    strongest, and a word for how consistent they are from {consistency}(ptype, consistency)."""
    return f"""WITH c AS (SELECT ptype, count(CASE WHEN padj < {num(alpha)} AND effect > 0 THEN 1 END) AS n_up, count(CASE WHEN padj < {num(alpha)} AND effect < 0 THEN 1 END) AS n_down FROM {{result}} GROUP BY ptype),
t AS (SELECT ptype, feature, row_number() OVER (PARTITION BY ptype ORDER BY padj, feature) AS i FROM {{result}})
SELECT c.ptype, c.n_up, c.n_down, t.feature AS strongest, CASE WHEN k.consistency >= {num(0.9)} THEN 'robust' WHEN k.consistency >= {num(0.7)} THEN 'sensitive' ELSE 'unstable' END AS robustness FROM c JOIN t ON c.ptype = t.ptype AND t.i = 1 LEFT JOIN {{consistency}} k ON k.ptype = c.ptype"""
