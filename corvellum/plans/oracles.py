"""DuckDB SQL written from the rules, apart from the texts that the queries run; it takes the place of the shared text.

Everything here is as plain as DuckDB allows (one window over all rows, its own gamma function, regular expressions), so
that a slip in an operator's text shows as a difference.
"""

from __future__ import annotations

from corvellum.plans import statistics
from corvellum.plans.sqlplan import duck

_LNF = "lgamma(CAST({} AS DOUBLE) + 1)"


def _tail(overlap: str, size: str, drawn: str, total: str) -> str:
    """Upper tail of the hypergeometric distribution as a list expression."""
    f = _LNF.format
    term = f"exp({f(size)} + {f(f'{total} - {size}')} + {f(drawn)} + {f(f'{total} - {drawn}')} - {f('k')} - {f(f'{size} - k')} - {f(f'{drawn} - k')} - {f(f'{total} - {size} - {drawn} + k')} - {f(total)})"
    return f"least(1.0::DOUBLE, list_sum(list_transform(list_filter(range({overlap}, least({size}, {drawn}) + 1), lambda k: k >= {size} + {drawn} - {total}), lambda k: {term})))"


def _t_two_sided(t: str, df: str) -> str:
    """Two-sided p of Student's t for whole degrees of freedom, by the finite sums in the angle whose tangent is t / sqrt(df)."""
    angle = f"atan(abs({t}) / sqrt(CAST({df} AS DOUBLE)))"
    even = f"list_sum(list_transform(range(0, {df} // 2), lambda k: exp(lgamma(k + 0.5::DOUBLE) - lgamma(0.5::DOUBLE) - lgamma(k + 1.0::DOUBLE)) * power(cos({angle}), 2 * k)))"
    odd = f"coalesce(list_sum(list_transform(range(0, ({df} - 1) // 2), lambda k: sqrt(pi()) / 2 * exp(lgamma(k + 1.0::DOUBLE) - lgamma(k + 1.5::DOUBLE)) * power(cos({angle}), 2 * k + 1))), 0)"
    return f"CASE WHEN {df} % 2 = 0 THEN 1 - sin({angle}) * {even} ELSE 1 - 2 / pi() * ({angle} + sin({angle}) * {odd}) END"


def _z_two_sided(z: str) -> str:
    """Two-sided p of a standard normal z, by Simpson's rule over twelve units from it on."""
    density = "exp(-power(abs({z}) + k * 0.003::DOUBLE, 2) / 2)"
    weight = "CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    return f"2 / sqrt(2 * pi()) * 0.001::DOUBLE * list_sum(list_transform(range(0, 4001), lambda k: {weight} * {density.format(z=z)}))"


_P = "SELECT o_orderkey AS id, o_orderpriority AS family, (o_orderkey * 37 % 1009 + 1) / 1010.0::DOUBLE AS p FROM orders"
_LABELLED = "SELECT n_chars AS score, quality AS positive FROM documents JOIN labels USING (doc_id)"
_REVENUE = "SELECT CAST(p_partkey AS VARCHAR) AS feature_id, sum(l_extendedprice * (1 - l_discount)) AS stat FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_partkey"
_TOP = f"SELECT feature_id FROM ({_REVENUE}) ORDER BY round(stat, 2) DESC, feature_id LIMIT 100"


def _adjusted(part: str, keys: str) -> str:
    w = f"PARTITION BY {part}" if part else ""
    return f"""WITH r AS (SELECT *, row_number() OVER ({w} ORDER BY p, id) AS i, count(*) OVER ({w}) AS m FROM ({_P})),
a AS (SELECT *, max(least(1.0::DOUBLE, p * (m + 1 - i))) OVER ({w} ORDER BY i) AS holm, min(least(1.0::DOUBLE, p * m / i)) OVER ({w} ORDER BY i DESC) AS bh FROM r)
SELECT {keys}, round(p, 6) AS p, round(least(1.0::DOUBLE, p * m), 6) AS bonferroni, round(holm, 6) AS holm, round(bh, 6) AS bh, holm < 0.05::DOUBLE AS holm_called, bh < 0.05::DOUBLE AS bh_called FROM a"""


def _with_p(text: str, p: str) -> str:
    return f"SELECT *, round({p}, 6) AS p FROM ({text}) x"


_A = "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_totalprice - 150000 AS effect, (o_orderkey * 37 % 1009 + 1) / 1010.0::DOUBLE AS padj FROM orders"
_B = "SELECT CAST(l_orderkey AS VARCHAR) AS id, sum(l_extendedprice) - 150000 AS effect, (l_orderkey * 41 % 1009 + 1) / 1010.0::DOUBLE AS padj FROM lineitem GROUP BY l_orderkey"
_MACHINERY = "ribosome|proteasome|spliceosome|oxidative phosphorylation|aminoacyl|rna polymerase|translation|protein processing in endoplasmic"
_ILLNESS = "infection|disease|cancer|carcinoma|leukemia|syndrome|diabetes|myocarditis|virus|hepatitis|tuberculosis|malaria|asthma|arthritis|addiction"

SQL = {
    "multiplicity": _adjusted("", "id"),
    "multiplicity_by_group": _adjusted("family", "id, family"),
    # the share of pairs (good, bad) that the score puts in order, ties counting half
    "auc_rank": f"WITH s AS ({_LABELLED}) SELECT round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END), 6) AS auc FROM s a JOIN s b ON a.positive = 1 AND b.positive = 0",
    "mann_whitney": f"""WITH s AS ({_LABELLED}), u AS (SELECT sum(CASE WHEN a.score > b.score THEN 1.0::DOUBLE WHEN a.score = b.score THEN 0.5::DOUBLE ELSE 0 END) AS u FROM s a JOIN s b ON a.positive = 1 AND b.positive = 0),
n AS (SELECT CAST(count(*) FILTER (positive = 1) AS DOUBLE) AS a, CAST(count(*) FILTER (positive = 0) AS DOUBLE) AS b FROM s), t AS (SELECT sum(k * k * k - k) AS t FROM (SELECT CAST(count(*) AS DOUBLE) AS k FROM s WHERE positive IS NOT NULL GROUP BY score))
SELECT round(u, 6) AS u, round((abs(u - a * b / 2) - 0.5) / sqrt(a * b / 12 * (a + b + 1 - t / ((a + b) * (a + b - 1)))), 6) AS z FROM u, n, t""",
    "correlations": """WITH x AS (SELECT o_totalprice AS x, c_acctbal AS y FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice IS NOT NULL AND c_acctbal IS NOT NULL),
r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS b FROM x)
SELECT round(corr(x, y), 6) AS pearson, round(corr(a, b), 6) AS spearman FROM r""",
    "ora": f"""WITH g AS ({_TOP}), o AS (SELECT p_brand AS term, count(*) AS size, count(g.feature_id) AS overlap FROM part LEFT JOIN g ON g.feature_id = CAST(p_partkey AS VARCHAR) GROUP BY p_brand HAVING count(g.feature_id) >= 3),
k AS (SELECT (SELECT count(*) FROM g) AS n, (SELECT count(*) FROM part) AS total), p AS (SELECT term, overlap, size, round((overlap / n) / (size / total), 6) AS fold, {_tail('overlap', 'size', 'n', 'total')} AS p FROM o, k),
r AS (SELECT *, round(p, 12) AS q, row_number() OVER (ORDER BY round(p, 12), term) AS i, count(*) OVER () AS m FROM p)
SELECT term, overlap, size, fold, round(p, 6) AS p, round(least(1.0::DOUBLE, min(q * m / i) OVER (ORDER BY i DESC)), 6) AS fdr FROM r""",
    "equal_bins": "WITH r AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS i, count(*) OVER () AS n FROM part) SELECT id, CAST(greatest(ceil(i * 25.0::DOUBLE / (n - 1)) - 1, 0) AS INTEGER) AS bin FROM r",
    "es_running_sum": f"""WITH r AS (SELECT feature_id, stat - 200000 AS stat, row_number() OVER (ORDER BY stat DESC, feature_id) AS i, count(*) OVER () AS n FROM ({_REVENUE})),
f AS (SELECT b.term, r.i, r.n, r.stat, p.p_brand = b.term AS inside FROM (SELECT DISTINCT p_brand AS term FROM part) b, r JOIN part p ON CAST(p.p_partkey AS VARCHAR) = r.feature_id),
t AS (SELECT *, sum(CASE WHEN inside THEN abs(stat) END) OVER (PARTITION BY term) AS w, count(*) FILTER (inside) OVER (PARTITION BY term) AS k FROM f),
s AS (SELECT term, k, i, sum(CASE WHEN inside THEN abs(stat) / w ELSE -1.0::DOUBLE / (n - k) END) OVER (PARTITION BY term ORDER BY i) AS run FROM t)
SELECT term, round(CASE WHEN max(run) >= -min(run) THEN max(run) ELSE min(run) END, 6) AS es FROM s WHERE k >= 5 GROUP BY term""",
    "generic_flags": rf"""WITH t AS (SELECT unnest(['Ribosome', 'Aminoacyl-tRNA biosynthesis', 'Something [mmu05999]', 'Asthma', 'hsa05223 unbracketed', 'Lung cancer [hsa05223]', 'Wnt signalling']) AS term UNION ALL SELECT DISTINCT p_type FROM part)
SELECT term, CASE WHEN regexp_matches(lower(term), '{_MACHINERY}') THEN 'housekeeping machinery' WHEN regexp_matches(lower(term), '{_ILLNESS}') OR regexp_matches(term, '\[(hsa|mmu|rno)05\d\d\d\]') THEN 'disease or infection name; may reflect generic genes' ELSE '' END AS flag FROM t""",
    "file_roles": r"""WITH f AS (SELECT unnest(['a_R1.fastq.gz', 'counts.txt', 'x.cram', 'GSE1_series_matrix.txt.gz', 'Snakefile', 'table.csv', 'Sample_sheet.csv', 'matrix.mtx.gz', 'run.py']) AS name UNION ALL SELECT url FROM pages)
SELECT name, CASE WHEN regexp_matches(lower(name), '\.(fastq|fq|fastq\.gz|fq\.gz|sra|bam|cram)$') THEN 'raw_reads' WHEN regexp_matches(lower(name), 'series_matrix|metadata|pheno|sample_info|samples|sdrf|design') THEN 'sample_metadata'
 WHEN regexp_matches(lower(name), 'count|matrix|expression|tpm|fpkm|rpkm|\.h5|\.mtx|normalized') THEN 'processed_matrix' WHEN regexp_matches(lower(name), '\.(py|r|rmd|ipynb|sh|smk)$|snakefile') THEN 'code' ELSE 'unknown' END AS role FROM f""",
    "order_checks": """WITH a AS (SELECT c_custkey + CASE WHEN c_custkey % 50 = 0 THEN 1 ELSE 0 END AS id, c_mktsegment AS label FROM customer)
SELECT 'unique cell IDs' AS check_name, CASE WHEN count(*) = count(DISTINCT id) THEN 'PASS' ELSE 'FAIL' END AS status, count(*) - count(DISTINCT id) AS figure FROM a
UNION ALL SELECT 'cell ID sets match metadata', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END, count(*) FROM ((SELECT id FROM a EXCEPT SELECT c_custkey FROM customer) UNION ALL (SELECT c_custkey FROM customer EXCEPT SELECT id FROM a))
UNION ALL SELECT 'column order vs metadata', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END, count(*) FROM a WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = a.id AND c.c_mktsegment = a.label)""",
    "first_of_each": "SELECT id, row_number() OVER (ORDER BY pos, id) AS place FROM (SELECT l_suppkey AS id, min(l_linenumber + 10 * l_orderkey) AS pos FROM lineitem GROUP BY l_suppkey)",
    "ranked_list": "SELECT upper(p_brand) AS feature_id, max(p_retailprice) - 1400 AS stat FROM part GROUP BY upper(p_brand)",
    # ranks over the whole table of units by features, zeros written out
    "rank_sum_markers": """WITH e AS (SELECT l_suppkey AS u, p_brand AS f, sum(l_quantity) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
o AS (SELECT s_suppkey AS u, CAST(n_regionkey AS VARCHAR) AS grp FROM supplier JOIN nation ON s_nationkey = n_nationkey),
g AS (SELECT o.u, o.grp, f.f, coalesce(e.v, 0) AS v FROM o CROSS JOIN (SELECT DISTINCT f FROM e) f LEFT JOIN e ON e.u = o.u AND e.f = f.f),
r AS (SELECT *, rank() OVER (PARTITION BY f ORDER BY v) + (count(*) OVER (PARTITION BY f, v) - 1) / 2.0::DOUBLE AS rk FROM g),
s AS (SELECT grp, f, sum(rk) AS s, CAST(count(*) AS DOUBLE) AS k, (SELECT CAST(count(*) AS DOUBLE) FROM o) AS n FROM r GROUP BY grp, f),
z AS (SELECT grp, f AS feature_id, round((s - k * (n + 1) / 2) / sqrt(k * (n - k) * (n + 1) / 12), 6) AS z FROM s WHERE k < n)
SELECT grp, feature_id, z, place FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY z DESC, feature_id) AS place FROM z) WHERE place <= 5""",
    "concordance": f"""WITH s AS (SELECT a.effect AS x, b.effect AS y, a.padj < 0.3::DOUBLE AS c, b.padj < 0.3::DOUBLE AS d FROM ({_A}) a JOIN ({_B}) b USING (id)),
r AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM s),
g AS (SELECT count(*) AS n, count(*) FILTER (c) AS sa, count(*) FILTER (d) AS sb, count(*) FILTER (c AND d) AS ov, count(*) FILTER (c OR d) AS one, avg(CASE WHEN sign(x) = sign(y) THEN 1.0 ELSE 0.0 END) FILTER (c AND d) AS same, corr(rx, ry) AS rho FROM r)
SELECT 'tested' AS status, n AS n_shared, sa AS sig_a, sb AS sig_b, ov AS overlap, round({_tail('ov', 'sa', 'sb', 'n')}, 6) AS overlap_p, round(ov / greatest(one, 1), 6) AS jaccard, round(same, 6) AS same_direction, round(rho, 6) AS effect_correlation FROM g""",
}

#: p-values of statistics whose own text has an oracle already.
SQL |= {
    "paired_p": _with_p(duck(statistics.SQL["paired_t"]), _t_two_sided("t_stat", "df")),
    "mann_whitney_p": _with_p(SQL["mann_whitney"], _z_two_sided("z")),
    "nb_p": _with_p(duck(statistics.SQL["nb_wald"]), _z_two_sided("z")),
    # three degrees of freedom: four languages, labelled or not
    "chi_square_p": _with_p(duck(statistics.SQL["chi_square"]), f"{_z_two_sided('sqrt(chi2)')} + sqrt(2 * chi2 / pi()) * exp(-chi2 / 2)"),
}


def _comparison(paired: bool) -> dict[str, str]:
    """Oracles of the comparison of orders by status, or, unpaired, by the parity of their nation, over a dense grid of units and features."""
    condition = "o_orderstatus" if paired else "CASE c_nationkey % 2 WHEN 0 THEN 'F' ELSE 'O' END"
    batch = "o_orderpriority" if paired else "c_nationkey"
    cells = f"""c AS (SELECT o_orderkey AS cell, c_nationkey AS s, {condition} AS k, {batch} AS b, year(o_orderdate) AS g,
  CASE c_mktsegment WHEN 'MACHINERY' THEN 'unassigned' ELSE c_mktsegment END AS t FROM orders, customer WHERE o_custkey = c_custkey)"""
    both = f"""per AS (PIVOT (SELECT s, k FROM c WHERE k IN ('F', 'O')) ON k IN ('F', 'O') USING count(*) GROUP BY s),
design AS (SELECT count(*) AS n_samples, count(*) FILTER ("F" >= 10) AS n_ref, count(*) FILTER ("O" >= 10) AS n_test, count(*) FILTER (least("F", "O") >= 10) AS n_both,
  count(*) >= 3 AND bool_and(least("F", "O") >= 10) AS paired FROM per)"""
    gate = f"""WITH {cells}, {both},
x AS (SELECT * FROM c WHERE k IN ('F', 'O')),
bt AS (SELECT b, min(k) = max(k) AS single FROM x GROUP BY b),
gr AS (SELECT g, avg(CASE k WHEN 'F' THEN 1.0::DOUBLE ELSE 0 END) AS f FROM x GROUP BY g)
SELECT (SELECT count(*) FROM x WHERE k = 'F') AS ref_cells, (SELECT count(*) FROM x WHERE k = 'O') AS test_cells, (SELECT count(*) FROM c WHERE k NOT IN ('F', 'O')) AS n_left_out,
  n_samples, n_ref, n_test, n_both, CASE WHEN least(n_ref, n_test) >= 3 THEN 'PASS' WHEN least(n_ref, n_test) = 2 THEN 'WARN' ELSE 'FAIL' END AS replicates, paired,
  CASE WHEN paired THEN 'PASS' WHEN n_both = 0 THEN 'INFO' ELSE 'WARN' END AS pairing,
  (SELECT count(*) FROM bt) AS n_batches, (SELECT count(*) FROM bt WHERE single) AS n_single, CASE WHEN EXISTS (FROM bt WHERE single) THEN 'WARN' ELSE 'PASS' END AS batch, (SELECT bool_and(single) FROM bt) AS confounded,
  n_groups, n_pure, CASE WHEN n_pure > n_groups / 2.0 THEN 'WARN' ELSE 'PASS' END AS clusters,
  n_unnamed, CASE WHEN n_unnamed >= 0.2 * n_x THEN 'WARN' ELSE 'INFO' END AS unlabelled
FROM design, (SELECT count(*) AS n_groups, count(*) FILTER (f >= 0.9 OR 1 - f >= 0.9) AS n_pure FROM gr), (SELECT count(*) AS n_x, count(*) FILTER (t = 'unassigned') AS n_unnamed FROM x)"""
    least = 10 if paired else 40
    types = f"""WITH {cells}, {both},
n AS (PIVOT (SELECT s, t, k FROM c WHERE k IN ('F', 'O') AND t <> 'unassigned') ON k IN ('F', 'O') USING count(*) GROUP BY t, s)
SELECT t AS ptype, sum("F")::BIGINT AS ref_cells, sum("O")::BIGINT AS test_cells, count(*) FILTER ("F" >= {least}) AS n_ref, count(*) FILTER ("O" >= {least}) AS n_test, count(*) FILTER (least("F", "O") >= {least}) AS n_pairs,
  CASE WHEN (SELECT paired FROM design) THEN count(*) FILTER (least("F", "O") >= {least}) >= 3 ELSE least(n_ref, n_test) >= 3 END AS testable,
  greatest(sum("F"), sum("O")) / sum("F" + "O") >= 0.9 AND sum("F" + "O") >= {3 * least} AS follows FROM n GROUP BY t""".replace("n_ref, n_test) >= 3", f'count(*) FILTER ("F" >= {least}), count(*) FILTER ("O" >= {least})) >= 3')
    units = f"""{cells}, {both},
units AS (SELECT t, s, k, count(*) AS n FROM c WHERE k IN ('F', 'O') AND t <> 'unassigned' GROUP BY t, s, k HAVING count(*) >= 10),
kept AS (SELECT t, s, k FROM units u WHERE NOT (SELECT paired FROM design) OR EXISTS (FROM units v WHERE v.t = u.t AND v.s = u.s AND v.k <> u.k)),
stored AS (SELECT c.t, c.s, c.k, p_brand AS f, sum(l_quantity) AS total FROM lineitem, part, c, kept WHERE l_partkey = p_partkey AND l_orderkey = c.cell AND kept.t = c.t AND kept.s = c.s AND kept.k = c.k GROUP BY ALL)"""
    bulk = f"WITH {units} SELECT t AS ptype, s AS sample, k AS condition, f AS feature, round(total, 6) AS total FROM stored"
    dense = f"""{units},
tested AS (SELECT t, f FROM stored GROUP BY t, f HAVING sum(total) >= 10 AND count(*) FILTER (total > 0) >= 3),
grid AS (SELECT kept.t, kept.s, kept.k, tested.f, coalesce(stored.total, 0) AS y FROM kept JOIN tested ON tested.t = kept.t LEFT JOIN stored ON stored.t = kept.t AND stored.s = kept.s AND stored.k = kept.k AND stored.f = tested.f),
logged AS (SELECT t, s, k, f, log2(y * 1000000 / greatest(sum(y) OVER (PARTITION BY t, s, k), 1) + 1) AS v FROM grid)"""
    side = lambda k: f"FILTER (k = '{k}')"
    # small tables can be unpaired by either choice of samples
    test = f"""WITH {dense},
d AS (SELECT t, f, a.v - b.v AS d FROM logged a JOIN logged b USING (t, f, s) WHERE a.k = 'O' AND b.k = 'F'),
m AS (SELECT t, f, count(*) {side("F")} AS n1, count(*) {side("O")} AS n2, avg(v) {side("O")} - avg(v) {side("F")} AS e, coalesce(var_samp(v) {side("F")}, 0) AS v1, coalesce(var_samp(v) {side("O")}, 0) AS v2 FROM logged GROUP BY t, f),
p AS (SELECT *, ((n1 - 1) * v1 + (n2 - 1) * v2) / nullif(n1 + n2 - 2, 0) AS pooled FROM m WHERE n1 > 0 AND n2 > 0)
SELECT t AS ptype, f AS feature, count(*) AS n_ref, count(*) AS n_test, round(avg(d), 6) AS effect, round(avg(d) / nullif(stddev_samp(d) / sqrt(count(*)), 0), 6) AS t_stat, count(*) - 1 AS df FROM d WHERE (SELECT paired FROM design) GROUP BY t, f
UNION ALL SELECT t, f, n1, n2, round(e, 6), round(e / nullif(sqrt(pooled * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2)), 0), 6), n1 + n2 - 2 FROM p WHERE NOT (SELECT paired FROM design)"""
    share = f"""WITH {cells}, {both},
u AS (SELECT s, k, count(*) AS n FROM c WHERE k IN ('F', 'O') GROUP BY s, k HAVING count(*) >= 10),
w AS (SELECT * FROM u WHERE NOT (SELECT paired FROM design) OR (SELECT count(*) FROM u v WHERE v.s = u.s) = 2),
y AS (SELECT t FROM c WHERE k IN ('F', 'O') AND t <> 'unassigned' GROUP BY t HAVING count(*) >= 30),
z AS (SELECT w.s, w.k, w.n, y.t, (SELECT count(*) FROM c WHERE c.s = w.s AND c.k = w.k AND c.t = y.t) AS m FROM w, y)
SELECT s AS sample, k AS condition, t AS ptype, m AS k, n, round(m / n, 6) AS share, round(ln(m + 0.5::DOUBLE) - avg(ln(m + 0.5::DOUBLE)) OVER (PARTITION BY s, k), 6) AS clr FROM z"""
    more = "" if paired else "_unpaired"
    return {f"design_gate{more}": gate, f"design_types{more}": types, f"pseudobulk{more}": bulk, f"abundance_share{more}": share, "paired_t" if paired else "unpaired_t": test}


SQL |= _comparison(True) | _comparison(False)

_CI = """SELECT o_orderkey AS id, CASE o_orderkey % 2 WHEN 0 THEN (ln(e) / ((ln(h) - ln(l)) / 3.919928)) ELSE e / ((h - l) / 3.919928) END AS z, round(o_orderkey % 100 / 1000.0::DOUBLE + 0.001, 6) AS p_reported
FROM (SELECT o_orderkey, o_totalprice / 100000.0::DOUBLE AS l, l + 1 AS e, l + 2.5 AS h FROM orders)"""
SQL["ci_p_agrees"] = f"SELECT id, round(p, 6) AS p_from_interval, p_reported, p >= p_reported / 2 AND p <= p_reported * 2 AS agrees FROM (SELECT *, {_z_two_sided('z')} AS p FROM ({_CI}))"
