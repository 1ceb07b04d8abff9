"""Queries that apply the operators to the driver's tables; each text runs in both engines."""

from __future__ import annotations

from corvellum.functions.sqltext import num, rounded
from corvellum.operators import compare, designs, enrich, inference, matrix, prose_checks, records
from corvellum.plans.sqlplan import fill

# Units are suppliers, features brands, samples nations, batches regions, conditions line statuses.
EXPR = "SELECT l_suppkey AS unit_id, p_brand AS feature_id, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, p_brand"
TYPES = "SELECT l_suppkey AS unit_id, p_type AS feature_id, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, p_type"
OBS = "SELECT s_suppkey AS unit_id, s_nationkey AS sample, n_regionkey AS grp FROM supplier JOIN nation ON s_nationkey = n_nationkey"
UNITS = "SELECT s_suppkey AS unit_id FROM supplier"
FEATURES = "SELECT DISTINCT p_brand AS feature_id FROM part"
CELLS = """SELECT s_nationkey AS sample, l_linestatus AS condition, n_regionkey AS batch, p_type AS grp, p_type AS ptype, p_brand AS feature, l_quantity AS value
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey"""
# Cells are orders, their values the brands that they hold; samples are the customers' nations, in both order statuses or, unpaired, in one
# that the nation goes by; types are market segments, one of them without a name.
DESIGN_CELLS = """SELECT o_orderkey AS unit_id, c_nationkey AS sample, o_orderstatus AS condition, o_orderpriority AS batch, year(o_orderdate) AS grp,
 CASE WHEN c_mktsegment = 'MACHINERY' THEN 'unassigned' ELSE c_mktsegment END AS ptype FROM orders JOIN customer ON o_custkey = c_custkey"""
UNPAIRED_CELLS = DESIGN_CELLS.replace("o_orderstatus AS condition", "CASE WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'O' END AS condition").replace("o_orderpriority AS batch", "c_nationkey AS batch")
DESIGN_VALUES = "SELECT l_orderkey AS unit_id, p_brand AS feature, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, p_brand"
P = f"SELECT o_orderkey AS id, o_orderpriority AS family, (o_orderkey * 37 % 1009 + 1) / {num(1010)} AS p FROM orders"
VALUES = "SELECT user_id AS cluster, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS grp, event_type, value FROM events"
LABELLED = "SELECT n_chars AS score, quality AS positive FROM documents JOIN labels ON documents.doc_id = labels.doc_id"
REVENUE = "SELECT CAST(p_partkey AS STRING) AS feature_id, sum(l_extendedprice * (1 - l_discount)) AS stat FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_partkey"
BRAND_SETS = "SELECT p_brand AS term, CAST(p_partkey AS STRING) AS feature_id FROM part"
PARTS = "SELECT CAST(p_partkey AS STRING) AS feature_id FROM part"
TOP_PARTS = f"SELECT feature_id FROM (SELECT feature_id, round(stat, 2) AS r FROM ({REVENUE}) x ORDER BY r DESC, feature_id LIMIT 100) y"
XY = "SELECT o_totalprice AS x, c_acctbal AS y FROM orders JOIN customer ON o_custkey = c_custkey"
RESULT_A = "SELECT CAST(o_orderkey AS STRING) AS id, o_totalprice - 150000 AS effect, (o_orderkey * 37 % 1009 + 1) / CAST(1010 AS DOUBLE) AS padj FROM orders"
RESULT_B = "SELECT CAST(l_orderkey AS STRING) AS id, sum(l_extendedprice) - 150000 AS effect, (l_orderkey * 41 % 1009 + 1) / CAST(1010 AS DOUBLE) AS padj FROM lineitem GROUP BY l_orderkey"
DIMS = "SELECT vec_id, label, d, embedding FROM embeddings CROSS JOIN (SELECT 0 AS d UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) k"
# Checks of forty groups, one for each event; and what there could have been.
RECORDS = """SELECT CAST(user_id % 40 AS STRING) AS grp, concat(event_type, ' ', CAST(event_id % 13 AS STRING)) AS check_name, event_id AS place,
 CASE WHEN event_id % 89 = 0 THEN 'FAIL' WHEN event_id % 17 = 0 THEN 'WARN' WHEN event_id % 5 = 0 THEN 'INFO' ELSE 'PASS' END AS status FROM events"""
CATALOGUE = "SELECT DISTINCT concat(event_type, ' ', CAST(event_id % 15 AS STRING)) AS check_name, event_type AS tests FROM events"

_metrics = fill(matrix.qc_metrics("feature_id IN ('PROMO')"), expr=TYPES)
_masks = fill(matrix.fail_masks(2, 6, 20.0), metrics=_metrics)
_sums = fill(matrix.linear_sums(), expr=EXPR)
_grid = fill(matrix.densified(), units=UNITS, features=FEATURES, expr=EXPR)
_stats = fill(matrix.group_stats(), expr=EXPR, obs=OBS)
_scaled = fill(matrix.rescaled(), stats=_stats)


def _design(cells: str) -> dict[str, str]:
    """The comparison's relations over one table of cells."""
    d = {"cells": cells, "values": DESIGN_VALUES, "gate": fill(designs.gate("F", "O"), cells=cells)}
    d["kept"] = fill(designs.kept_units("F", "O"), **d)
    d["bulk"] = fill(designs.bulk(), **d)
    d["tested"] = fill(designs.tested_features(), **d)
    d["logs"] = fill(designs.logs(), **d)
    d["shares"] = fill(designs.shares("F", "O"), **d)
    d["effects"] = fill(designs.effects("F", "O"), **d)
    return d


_paired, _unpaired = DESIGNS = _design(DESIGN_CELLS), _design(UNPAIRED_CELLS)
_consistency = fill(designs.consistency("F", "O"), called=f"SELECT ptype, feature, effect FROM ({_paired['effects']}) e WHERE effect <> 0", **_paired)
_bulk, _logs, _shares = (_paired[k] for k in ("bulk", "logs", "shares"))
_rollup = fill(records.status_rollup(), records=RECORDS)
_ratings = fill(records.ratings(), rollup=f"SELECT *, CASE WHEN n_fail = 1 THEN 'known' END AS accepted FROM ({_rollup}) r")
_panel = "SELECT 'T1' AS cell_type, 'Brand#11' AS gene, '+' AS sign UNION ALL SELECT 'T1', 'Brand#12', '+' UNION ALL SELECT 'T1', 'Brand#13', '-' UNION ALL SELECT 'T2', 'Brand#21', '+' UNION ALL SELECT 'T2', 'Brand#22', '+' UNION ALL SELECT 'T2', 'Brand#23', '+' UNION ALL SELECT 'T2', 'Brand#11', '-'"
_scores = fill(enrich.panel_scores(), stats=_scaled, panel=_panel)
_overlaps = fill(enrich.overlaps(), genes=TOP_PARTS, background=PARTS, sets=BRAND_SETS)
_wells = "SELECT s_nationkey AS plate, l_orderkey * 10 + l_linenumber AS well, CASE WHEN l_linenumber = 1 THEN 'TRUCK' WHEN l_linenumber = 2 THEN 'PROMO' ELSE 'x' END AS kind, l_quantity AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"
_plates = "SELECT l_suppkey % 7 AS plate, p_size % 8 AS r, l_linenumber AS c, avg(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey % 7, p_size % 8, l_linenumber"
_labels = "SELECT label AS a, CAST(floor((embedding[{i}] + 3) * 2) AS INT) AS b FROM embeddings"

SQL = {
    # filters, checks, normalisation
    "qc_metrics": _metrics,
    "qc_masks": _masks,
    "filter_impact": fill(matrix.filter_impact(), masks=_masks, obs=OBS),
    "min_cells_filter": fill(matrix.seen_features(3), expr=EXPR),
    "missing_members": fill(matrix.missing_members(["Brand#11", "Brand#55", "Brand#99"]), features=FEATURES),
    "signal_present": fill(matrix.signal_present(), metrics=_metrics),
    "alignment": fill(matrix.alignment(), a="SELECT doc_id AS id, lang AS label FROM documents", b="SELECT labels.doc_id AS id, CASE WHEN labels.doc_id % 7 = 0 THEN 'xx' ELSE lang END AS label FROM labels JOIN documents ON labels.doc_id = documents.doc_id"),
    "order_checks": fill(matrix.order_checks(), a="SELECT c_custkey AS pos, c_custkey + CASE WHEN c_custkey % 50 = 0 THEN 1 ELSE 0 END AS id, c_mktsegment AS label FROM customer", b="SELECT c_custkey AS id, c_mktsegment AS label FROM customer"),
    "expected_values": fill(matrix.expected_values(), figures="SELECT c_mktsegment AS name, CAST(count(*) AS STRING) AS observed, CASE WHEN c_mktsegment < 'C' THEN CAST(count(*) AS STRING) ELSE '7' END AS expected FROM customer GROUP BY c_mktsegment"),
    "first_of_each": fill(matrix.first_of_each(), rows="SELECT l_linenumber + 10 * l_orderkey AS pos, l_suppkey AS id FROM lineitem"),
    "selection_checks": fill(matrix.selection_checks(5, 3), selected="SELECT p_brand AS feature_id FROM part GROUP BY p_brand HAVING count(*) % 2 = 0", stats="SELECT p_brand AS feature_id, avg(p_retailprice) AS mean, count(CASE WHEN p_size > 25 THEN 1 END) / CAST(count(*) AS DOUBLE) AS detected FROM part GROUP BY p_brand", half_a="SELECT p_brand AS feature_id FROM part WHERE p_partkey % 2 = 0 GROUP BY p_brand HAVING count(*) > 3", half_b="SELECT p_brand AS feature_id FROM part WHERE p_partkey % 2 = 1 GROUP BY p_brand HAVING count(*) > 3", batches="SELECT p_brand AS feature_id, count(DISTINCT p_type) AS n FROM part GROUP BY p_brand"),
    "scale_detect_counts": fill(matrix.detect_scale(), expr="SELECT l_orderkey AS unit_id, l_partkey AS feature_id, l_quantity AS value FROM lineitem"),
    "scale_detect_prices": fill(matrix.detect_scale(), expr="SELECT l_orderkey AS unit_id, l_partkey AS feature_id, l_extendedprice AS value FROM lineitem"),
    "expected_counts": fill(matrix.expected_counts(), found="SELECT lang AS k FROM documents", expected="SELECT 'en' AS k, CAST(100 AS BIGINT) AS n UNION ALL SELECT 'it', CAST(5 AS BIGINT)"),
    "normalise_log1p_cp10k": fill(matrix.normalise("counts"), expr=EXPR),
    "linear_stats": _sums,
    "normalisation_checks": fill(matrix.normalisation_checks(), sums=_sums, obs=OBS),
    "variable_features": fill(matrix.variable_features("CAST((SELECT count(*) FROM supplier) AS DOUBLE)"), expr=EXPR),
    "detected_somewhere": fill(matrix.detected_somewhere(), expr=EXPR, obs=OBS),
    "group_stats": _stats,
    "rescaled_stats": _scaled,
    "z_scores": fill(matrix.z_scores(), grid=_grid),
    "sample_flags": fill(matrix.robust_flags(), samples="SELECT user_id AS sample, sum(value) AS total, CAST(count(DISTINCT event_type) AS DOUBLE) AS seen, median(value) AS mid FROM events GROUP BY user_id"),
    "presence_fill": fill(matrix.present_and_filled(), grid="SELECT doc_id AS unit_id, lang AS feature_id, CASE WHEN n_chars > 500 THEN CAST(n_chars AS DOUBLE) END AS value FROM documents"),
    "median_centre": fill(matrix.median_centred(), grid="SELECT user_id AS unit_id, event_id AS feature_id, value FROM events"),
    "wide_unpivot": fill(matrix.unpivoted(["l_quantity", "l_discount", "l_tax"], "l_orderkey * 10 + l_linenumber"), wide="SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem"),
    # comparison
    "design_gate": _paired["gate"],
    "design_gate_unpaired": _unpaired["gate"],
    "design_types": fill(designs.types("F", "O"), **_paired),
    "design_types_unpaired": fill(designs.types("F", "O", 40), **_unpaired),
    "pseudobulk": f"SELECT ptype, sample, condition, feature, {rounded('total')} AS total FROM ({_bulk}) b",
    "pseudobulk_unpaired": f"SELECT ptype, sample, condition, feature, {rounded('total')} AS total FROM ({_unpaired['bulk']}) b",
    "log_cpm": f"SELECT ptype, sample, condition, feature, {rounded('v')} AS v FROM ({_logs}) l",
    "paired_t": _paired["effects"],
    "unpaired_t": _unpaired["effects"],
    "direction_consistency": _consistency,
    "abundance_share": f"SELECT sample, condition, ptype, k, n, {rounded('share')} AS share, {rounded('clr')} AS clr FROM ({_shares}) s",
    "abundance_share_unpaired": f"SELECT sample, condition, ptype, k, n, {rounded('share')} AS share, {rounded('clr')} AS clr FROM ({_unpaired['shares']}) s",
    "composition_ratio": fill(compare.share_ratio("F", "O"), shares=_shares),
    "abundance_logit": fill(compare.abundance_logit("F", "O"), shares=_shares),
    "clr_ols": fill(designs.share_effects("F", "O"), **_paired),
    "clr_ols_unpaired": fill(designs.share_effects("F", "O"), **_unpaired),
    "units_by_condition": fill(compare.two_way_counts("sample", "condition", ("F", "O")), rows=CELLS),
    # multiple testing, effects, agreement
    "multiplicity": fill(inference.multiplicity(), p=P),
    "multiplicity_by_group": fill(inference.multiplicity("family"), p=P),
    "p_curve": fill(inference.p_curve(), p=P),
    "auc_rank": fill(inference.auc(), scored=LABELLED),
    "mann_whitney": fill(inference.mann_whitney(), scored=LABELLED),
    "correlations": fill(inference.correlations(), xy=XY),
    "icc_design_effect": fill(inference.icc(), rows=VALUES),
    "welch_rows": fill(inference.welch(), rows=VALUES),
    "chi_square": fill(inference.chi_square(), rows="SELECT lang AS a, CASE WHEN labels.doc_id IS NULL THEN 1 ELSE 0 END AS b FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id"),
    "missingness": fill(inference.missingness(("quality", "toxic"), "lang"), rows="SELECT lang, quality, toxic FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id"),
    "funnel_smd": fill(inference.funnel("n_chars"), eligible="SELECT n_chars FROM documents", analysed="SELECT n_chars FROM documents JOIN labels ON documents.doc_id = labels.doc_id"),
    "eta2_share": fill(inference.eta_squared(), rows="SELECT event_type AS grp, 0 AS col, value FROM events UNION ALL SELECT event_type, 1, value * value FROM events"),
    "adjusted_rand": fill(inference.adjusted_rand(), labels="SELECT c_mktsegment AS a, c_nationkey % 5 AS b FROM customer"),
    "jaccard_best": fill(inference.best_jaccard(), labels="SELECT c_mktsegment AS a, c_nationkey AS b FROM customer"),
    "rank_labels": fill(inference.ranked_labels(), labels="SELECT c_custkey AS id, c_mktsegment AS label FROM customer"),
    "batch_dominance": fill(inference.batch_dominance(0.3), rows="SELECT s_nationkey AS cluster, l_returnflag AS batch FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"),
    "majority_label": fill(inference.majority_label(0.4), rows="SELECT p_brand AS cluster, p_type AS label FROM part"),
    "concordance": fill(inference.concordance(0.3), a=RESULT_A, b=RESULT_B),
    "set_overlap": fill(inference.set_overlap(), a="SELECT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R'", b="SELECT l_partkey AS id FROM lineitem WHERE l_returnflag = 'A'"),
    "pair_duplicates": fill(inference.near_duplicate_columns(3, 0.9), long="SELECT user_id AS sample, event_type AS feature, avg(value) AS value FROM events GROUP BY user_id, event_type"),
    "gap_break": fill(inference.gaps_broken(3.0), points="SELECT l_suppkey AS series, l_partkey AS x, sum(l_quantity) AS y FROM lineitem GROUP BY l_suppkey, l_partkey"),
    "id_reconcile": fill(inference.reconciled_ids(), a="SELECT c_name AS id FROM customer", b="SELECT CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN upper(replace(c_name, '#', '#')) ELSE concat(c_name, 'x') END AS id FROM customer"),
    "equal_bins": fill(inference.equal_bins(), rows="SELECT p_partkey AS id, p_retailprice AS value FROM part"),
    "expectation_check": fill(inference.expectation_check(), rules="SELECT 'grows' AS name, 'brand#11' AS feature, 'up' AS direction UNION ALL SELECT 'grows', 'Brand#12', 'up' UNION ALL SELECT 'quiet', 'Brand#13', 'none' UNION ALL SELECT 'quiet', 'Brand#14', 'none' UNION ALL SELECT 'absent', 'Brand#99', 'up'", result="SELECT p_brand AS feature, avg(p_retailprice) - 1400 AS effect, min(p_partkey) % 100 / CAST(100 AS DOUBLE) AS padj FROM part GROUP BY p_brand"),
    # enrichment and annotation
    "sets_in_background": fill(enrich.sets_in_background(5, 500), sets=BRAND_SETS, background="SELECT CAST(p_partkey AS STRING) AS feature_id FROM part WHERE p_size > 10"),
    "ora_overlaps": _overlaps,
    "ora": fill(enrich.hypergeometric(), overlaps=_overlaps),
    "es_running_sum": fill(enrich.running_score(5), ranked=REVENUE.replace(" AS stat", " - 200000 AS stat"), sets=BRAND_SETS),
    "ranked_list": fill(enrich.ranked_list(), result="SELECT lower(p_brand) AS feature, p_retailprice - 1400 AS stat FROM part UNION ALL SELECT p_brand, CAST(NULL AS DOUBLE) FROM part"),
    "unit_expectations": fill(enrich.unit_expectations(), rules=f"SELECT 'higher' AS expectation, 'gene_up' AS kind, 'region' AS col, '1' AS grp, '' AS against, 'up' AS direction, CAST(NULL AS DOUBLE) AS min_fraction, CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high UNION ALL SELECT 'lower', 'gene_up', 'region', '2', '3', 'down', {num(0.3)}, NULL, NULL UNION ALL SELECT 'share', 'fraction_range', 'region', '1', '', 'up', NULL, {num(0.1)}, {num(0.5)} UNION ALL SELECT 'term', 'set_enriched', 'region', '1', '', 'up', NULL, NULL, NULL UNION ALL SELECT 'nobody', 'gene_up', 'region', '99', '', 'up', NULL, NULL, NULL UNION ALL SELECT 'nothing', 'gene_up', 'region', '1', '', 'up', NULL, NULL, NULL",
        wanted="SELECT 'higher' AS expectation, 'brand#11' AS feature_id UNION ALL SELECT 'higher', 'Brand#12' UNION ALL SELECT 'lower', 'Brand#21' UNION ALL SELECT 'lower', 'Brand#22' UNION ALL SELECT 'term', 'wnt' UNION ALL SELECT 'nobody', 'Brand#11' UNION ALL SELECT 'nothing', 'none such'", expr=EXPR, obs="SELECT s_suppkey AS unit_id, 'region' AS col, CAST(n_regionkey AS STRING) AS grp FROM supplier JOIN nation ON s_nationkey = n_nationkey", hits="SELECT '1' AS grp, 'Wnt signalling' AS term"),
    "generic_flags": fill(enrich.generic_terms(), terms="SELECT 'Ribosome' AS term UNION ALL SELECT 'Aminoacyl-tRNA biosynthesis' UNION ALL SELECT 'Something [mmu05999]' UNION ALL SELECT 'Asthma' UNION ALL SELECT 'hsa05223 unbracketed' UNION ALL SELECT 'Lung cancer [hsa05223]' UNION ALL SELECT 'Wnt signalling' UNION ALL SELECT DISTINCT p_type FROM part"),
    "group_scores_topk": fill(enrich.group_scores(), expr=EXPR, obs=OBS),
    "set_score": fill(enrich.set_scores(5), grid=_grid, sets="SELECT DISTINCT p_type AS term, p_brand AS feature_id FROM part WHERE p_size < 5"),
    "panel_score": _scores,
    "call_tiers": fill(enrich.called_types(), scores=f"SELECT s.*, CAST(20 AS BIGINT) AS n_cells FROM ({_scores}) s"),
    # checkpoints told in words
    "intake_checks": fill(prose_checks.intake(), grid="SELECT doc_id AS unit_id, lang AS feature_id, CASE WHEN n_chars > 500 THEN CAST(n_chars AS DOUBLE) END AS value FROM documents"),
    "quality_flags": fill(prose_checks.quality_flags(), samples="SELECT user_id AS sample, sum(value) AS total, CAST(count(DISTINCT event_type) AS DOUBLE) AS seen, median(value) AS mid FROM events GROUP BY user_id"),
    "size_factors": fill(prose_checks.size_factors(), expr="SELECT c_nationkey AS unit_id, c_mktsegment AS feature_id, sum(c_acctbal + 1000) AS value FROM customer GROUP BY c_nationkey, c_mktsegment", units="SELECT DISTINCT c_nationkey AS unit_id FROM customer"),
    "quantile_normalise": fill(prose_checks.quantile_normalised(), grid=_grid),
    "percent_of_control": fill(prose_checks.percent_of_control("TRUCK"), wells=_wells),
    "z_prime": fill(prose_checks.z_prime("TRUCK", "PROMO"), wells=_wells),
    "b_scores": fill(prose_checks.b_scores(), grid=_plates),
    "edge_effect": fill(prose_checks.edge_effect(), grid=_plates),
    "guide_coverage": fill(prose_checks.guide_coverage(), guides="SELECT l_returnflag AS sample, l_partkey AS guide, sum(l_quantity) AS reads FROM lineitem GROUP BY l_returnflag, l_partkey"),
    "names_usable": fill(prose_checks.names_usable(), a="SELECT lower(p_brand) AS id FROM part UNION ALL SELECT 'none such'", b="SELECT p_brand AS id FROM part"),
    "condition_followers": fill(prose_checks.followers(0.4), rows="SELECT p_type AS grp, l_linestatus AS condition FROM lineitem JOIN part ON l_partkey = p_partkey"),
    "highest_variance": "SELECT feature_id, " + "round(var_pop(value), 6) AS v FROM (" + _grid + ") g GROUP BY feature_id ORDER BY v DESC, feature_id LIMIT 10",
    # records, ledgers, consistency of reported numbers
    "status_rollup": _rollup,
    "rating": _ratings,
    "run_rating": fill(records.run_rating(), ratings=_ratings),
    "not_run": fill(records.not_run(), catalogue=CATALOGUE, records=RECORDS),
    "card_rows": fill(records.card_rows(5, 2), records=RECORDS),
    "grim": fill(records.grim(), means=f"SELECT l_suppkey AS id, floor(avg(l_quantity) * 100) / {num(100)} + (l_suppkey % 3) / {num(100)} AS mean, CAST(count(*) AS DOUBLE) AS n, 2 AS decimals, {num(1)} AS items FROM lineitem GROUP BY l_suppkey"),
    "ci_check": fill(records.interval_z(), cis=f"SELECT o_orderkey AS id, o_totalprice / {num(1e5)} AS estimate, o_totalprice / {num(2e5)} AS low, o_totalprice / {num(4e4)} AS high, o_orderkey % 2 = 0 AS ratio FROM orders"),
    "smd": fill(records.smd(), groups="SELECT s_nationkey AS id, avg(s_acctbal) AS m1, coalesce(stddev_samp(s_acctbal), 1) AS sd1, CAST(count(*) + 5 AS DOUBLE) AS n1, avg(s_acctbal) * 2 AS m2, coalesce(stddev_samp(s_acctbal), 1) + 1 AS sd2, CAST(count(*) + 9 AS DOUBLE) AS n2 FROM supplier GROUP BY s_nationkey"),
    "reproduction": fill(records.reproduction(), pairs=f"SELECT o_orderkey AS id, floor(o_totalprice / 100) / {num(100)} AS reported, floor(o_totalprice / 100) / {num(100)} + (o_orderkey % 5 - 2) * {num(0.004)} + CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice / 100 ELSE {num(0)} END AS recomputed, 2 AS decimals FROM orders"),
    "claims": fill(records.claim_ledger(), claims="SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'Verified' WHEN 1 THEN 'Contradicted' WHEN 2 THEN 'Partially verified' WHEN 3 THEN 'Not assessable' ELSE 'Perhaps' END AS verdict, CASE WHEN o_orderkey % 3 = 0 THEN 'rerun' ELSE '' END AS reproduction, CASE WHEN o_orderkey % 7 < 4 THEN 'x' END AS reason FROM orders"),
    "concerns": fill(records.concern_ledger(), concerns="SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'sure' END AS confidence, CASE o_orderkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS impact FROM orders"),
    "file_roles": fill(records.file_roles(), files="SELECT 'a_R1.fastq.gz' AS name UNION ALL SELECT 'counts.txt' UNION ALL SELECT 'x.cram' UNION ALL SELECT 'GSE1_series_matrix.txt.gz' UNION ALL SELECT 'Snakefile' UNION ALL SELECT 'table.csv' UNION ALL SELECT 'Sample_sheet.csv' UNION ALL SELECT 'matrix.mtx.gz' UNION ALL SELECT 'run.py' UNION ALL SELECT url FROM pages"),
    "spec_curve": fill(records.spec_curve((50000.0, 100000.0), (200000.0, 500000.0)), rows="SELECT c_acctbal * 20 AS x, o_totalprice AS y FROM orders JOIN customer ON o_custkey = c_custkey"),
    "designs": fill(records.design_fields(), designs="SELECT o_orderkey AS id, o_orderpriority AS question, CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE 'order' END AS unit, o_orderstatus AS comparison, CASE WHEN o_orderkey % 7 > 0 THEN 'price' END AS outcome, 'd' AS decision FROM orders"),
    "evidence": fill(records.evidence_manifest(), evidence="SELECT page_id AS id, CASE page_id % 3 WHEN 0 THEN 'retrieved' WHEN 1 THEN 'restricted' ELSE 'lost' END AS status, url AS path, CAST(length(url) AS BIGINT) AS bytes, sha2(url, 256) AS sha256 FROM pages"),
    "simulations": fill(records.simulation_ledger(), sims="SELECT o_orderkey AS id, o_orderstatus AS purpose, CASE WHEN o_orderkey % 6 > 0 THEN 'g' END AS generator, 'x' AS parameters, o_orderkey % 4 AS n_runs, o_custkey AS seed, 'o' AS outcome, CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE 'g' END AS guard FROM orders"),
    "claim_alignment": fill(records.alignment_ledger(), rows="SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'strong' WHEN 1 THEN 'moderate' WHEN 2 THEN 'weak' WHEN 3 THEN 'none' ELSE 'huge' END AS strength, CASE o_orderkey % 4 WHEN 0 THEN 'aligned' WHEN 1 THEN 'overstated' WHEN 2 THEN 'inconsistent' ELSE 'off' END AS alignment, CASE WHEN o_orderkey % 3 = 0 THEN 'why' ELSE '' END AS note FROM orders"),
    "symmetric_limits": fill(records.symmetric_limits(), values="SELECT c_acctbal AS v FROM customer"),
    "bubble_areas": fill(records.bubble_areas(), values="SELECT c_custkey AS id, c_acctbal AS v FROM customer"),
    "program_usage": fill(enrich.program_usage(0.2), usage="SELECT event_id AS unit_id, user_id % 7 AS ptype, event_type AS program, value FROM events"),
    "shared_markers": fill(enrich.shared_markers(), markers=f"SELECT grp, feature_id AS gene FROM ({fill(enrich.group_scores(), expr=EXPR, obs=OBS)}) m", panel=_panel, calls="SELECT 1 AS grp, 'T1' AS label UNION ALL SELECT 2, 'T2'"),
    "findings": fill(enrich.findings(0.2), result=f"SELECT ptype, feature, effect, abs(effect) AS padj FROM ({_paired['effects']}) r", consistency=_consistency),
    "nb_wald": fill(compare.nb_wald("F", "O"), bulk=_bulk),
    "rank_sum_markers": fill(compare.rank_sum_markers(), expr=EXPR, obs=OBS),
}
