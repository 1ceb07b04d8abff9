"""Check records, ratings, ledgers and arithmetic consistency, over small relations."""

from __future__ import annotations

from corvellum.functions.sqltext import num, rounded


def _even(x: str) -> str:
    """x in units of its last reported decimal, halves to even."""
    return f"bround({x} * power({num(10)}, decimals), 0)"


def status_rollup() -> str:
    """Counts of each status and the worst, per group of {records}(grp, check_name, status); INFO doesn't count."""
    n = lambda s: f"count(CASE WHEN status = '{s}' THEN 1 END)"
    return f"SELECT grp, {n('PASS')} AS n_pass, {n('WARN')} AS n_warn, {n('FAIL')} AS n_fail, {n('INFO')} AS n_info, CASE WHEN {n('FAIL')} > 0 THEN 'FAIL' WHEN {n('WARN')} > 0 THEN 'WARN' ELSE 'PASS' END AS overall FROM {{records}} GROUP BY grp"


def ratings() -> str:
    """A rating in words of each row of {rollup} with accepted (reason or null)."""
    return "SELECT grp, CASE WHEN n_pass + n_warn + n_fail + n_info = 0 THEN 'Not done' WHEN n_pass + n_warn + n_fail = 0 THEN 'Not applicable' WHEN n_fail > 0 AND accepted IS NOT NULL THEN 'Accepted despite a failed check' WHEN n_fail > 0 THEN 'Not reliable until fixed' WHEN n_warn > 0 THEN concat('Usable, with ', CAST(n_warn AS STRING), CASE WHEN n_warn = 1 THEN ' caveat' ELSE ' caveats' END) ELSE 'Good' END AS rating FROM {rollup}"


def run_rating() -> str:
    """The worst of {ratings}(grp, rating), for a whole run."""
    return "SELECT CASE WHEN count(CASE WHEN rating = 'Not reliable until fixed' THEN 1 END) > 0 THEN 'Not reliable until fixed' WHEN count(CASE WHEN rating = 'Not done' THEN 1 END) > 0 THEN 'Not done' WHEN count(CASE WHEN startswith(rating, 'Accepted') OR startswith(rating, 'Usable') THEN 1 END) > 0 THEN 'Usable' ELSE 'Good' END AS rating FROM {ratings}"


def not_run() -> str:
    """Checks of {catalogue}(check_name, tests) that {records} doesn't have."""
    return "SELECT c.check_name, c.tests FROM {catalogue} c WHERE NOT EXISTS (SELECT 1 FROM {records} r WHERE r.check_name = c.check_name)"


def card_rows(passes: int = 5, infos: int = 2) -> str:
    """Rows of {records}(grp, check_name, status, place) that a card shows: every FAIL and WARN, the first of the others."""
    return f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY grp, status ORDER BY place, check_name) AS i FROM {{records}}) SELECT grp, check_name, status, place FROM r WHERE status IN ('FAIL', 'WARN') OR status = 'PASS' AND i <= {passes} OR status = 'INFO' AND i <= {infos}"


def grim() -> str:
    """Whether whole numbers over n can have the reported mean, over {means}(id, mean, n, decimals, items)."""
    tries = " OR ".join(f"abs({_even(f'(floor(mean * n * items) + {d}) / (n * items)')} - {_even('mean')}) < {num(1e-6)}" for d in (-1, 0, 1, 2))
    return f"SELECT id, {tries} AS possible FROM {{means}}"


def interval_z() -> str:
    """Standard error and z that a 95% interval implies, over {cis}(id, estimate, low, high, ratio)."""
    side = lambda x: f"CASE WHEN ratio THEN ln(CASE WHEN ratio THEN {x} ELSE {num(1)} END) ELSE {x} END"
    return f"SELECT id, {rounded(f'({side("high")} - {side("low")}) / ({num(2)} * {num(1.959964)})')} AS se, {rounded(f'({side("estimate")}) / (({side("high")} - {side("low")}) / ({num(2)} * {num(1.959964)}))')} AS z FROM {{cis}}"


def interval_agrees(cis, factor: float = 2.0):
    """(id, p_from_interval, p_reported, agrees) of a DataFrame (id, estimate, low, high, ratio, p_reported): whether the p that a 95 % interval implies
    lies within a factor of the reported one; null where either is missing or the interval has no width."""
    from pyspark.sql import functions as F

    from corvellum.functions.dist import z_p

    side = lambda c: F.when(F.col("ratio"), F.log(c)).otherwise(F.col(c).cast("double"))
    width = (side("high") - side("low")) / (2 * 1.959964)
    z = side("estimate") / F.when(width > 0, width)
    found = cis.select("id", z_p(z).alias("p_from_interval"), F.col("p_reported").cast("double").alias("p_reported"))
    return found.withColumn("agrees", F.col("p_from_interval").between(F.col("p_reported") / factor, F.col("p_reported") * factor))


def smd() -> str:
    """Pooled deviation, d, its small-sample correction and a 95% interval, over {groups}(id, m1, sd1, n1, m2, sd2, n2)."""
    return f"""WITH a AS (SELECT id, m1, m2, n1, n2, sqrt(((n1 - 1) * sd1 * sd1 + (n2 - 1) * sd2 * sd2) / (n1 + n2 - 2)) AS sp FROM {{groups}}), b AS (SELECT id, n1, n2, sp, (m1 - m2) / sp AS d FROM a),
c AS (SELECT *, d * ({num(1)} - {num(3)} / ({num(4)} * (n1 + n2) - {num(9)})) AS g, sqrt((n1 + n2) / (n1 * n2) + d * d / ({num(2)} * (n1 + n2))) AS se FROM b)
SELECT id, {rounded('sp')} AS pooled_sd, {rounded('d')} AS d, {rounded('g')} AS g, {rounded(f'g - {num(1.959964)} * se')} AS low, {rounded(f'g + {num(1.959964)} * se')} AS high FROM c"""


def reproduction(tolerance: float = 0.02) -> str:
    """match, minor or major difference of {pairs}(id, reported, recomputed, decimals)."""
    return f"SELECT id, CASE WHEN abs({_even('recomputed')} - {_even('reported')}) < {num(1e-6)} THEN 'match' WHEN abs(recomputed - reported) <= {num(tolerance)} * greatest(abs(reported), {num(1e-12)}) THEN 'minor' ELSE 'major' END AS verdict FROM {{pairs}}"


def claim_ledger() -> str:
    """Claims of {claims}(id, verdict, reproduction, reason), with why a row is rejected."""
    return "SELECT id, verdict, CASE WHEN verdict NOT IN ('Verified', 'Contradicted', 'Partially verified', 'Not assessable') THEN 'unknown verdict' WHEN verdict IN ('Verified', 'Contradicted') AND coalesce(reproduction, '') = '' THEN 'needs a reproduction' WHEN verdict = 'Not assessable' AND coalesce(reason, '') = '' THEN 'needs a reason' END AS rejected FROM {claims}"


def concern_ledger() -> str:
    """Concerns of {concerns}(id, confidence, impact 'low'..'high') by priority, confidence times impact."""
    level = lambda c: f"CASE {c} WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 END"
    return f"SELECT id, {level('confidence')} * {level('impact')} AS priority, CASE WHEN {level('confidence')} IS NULL OR {level('impact')} IS NULL THEN 'unknown level' END AS rejected FROM {{concerns}}"


# Endings and words that tell the role of a file, in the order in which they are tried.
RAW_ENDINGS = (".fastq", ".fq", ".fastq.gz", ".fq.gz", ".sra", ".bam", ".cram")
SAMPLE_WORDS = ("series_matrix", "metadata", "pheno", "sample_info", "samples", "sdrf", "design")
MATRIX_WORDS = ("count", "matrix", "expression", "tpm", "fpkm", "rpkm", ".h5", ".mtx", "normalized")
CODE_ENDINGS = (".py", ".r", ".rmd", ".ipynb", ".sh", ".smk")


def _kept(names: tuple[str, ...]) -> str:
    return "".join(f", {n}" for n in names)


def file_roles(keep: tuple[str, ...] = ()) -> str:
    """The role of each file of {files}(name), by its ending or words in it; further columns can be kept."""
    has = lambda ws: " OR ".join(f"instr(lower(name), '{x}') > 0" for x in ws)
    end = lambda ws: " OR ".join(f"endswith(lower(name), '{x}')" for x in ws)
    return f"SELECT name, CASE WHEN {end(RAW_ENDINGS)} THEN 'raw_reads' WHEN {has(SAMPLE_WORDS)} THEN 'sample_metadata' WHEN {has(MATRIX_WORDS)} THEN 'processed_matrix' WHEN {end(CODE_ENDINGS)} OR {has(('snakefile',))} THEN 'code' ELSE 'unknown' END AS role{_kept(keep)} FROM {{files}}"


def spec_curve(thresholds: tuple[float, ...], drop: tuple[float, ...]) -> str:
    """Estimate under each combination of a threshold and an outlier share, mean and median, over {rows}(x, y)."""
    t = " UNION ALL ".join(f"SELECT {num(x)} AS threshold" for x in thresholds)
    d = " UNION ALL ".join(f"SELECT {num(x)} AS above" for x in drop)
    return f"""WITH spec AS (SELECT threshold, above FROM ({t}) t CROSS JOIN ({d}) d)
SELECT s.threshold, s.above, count(*) AS n, {rounded(f'avg(CASE WHEN x >= threshold THEN y END) - avg(CASE WHEN x < threshold THEN y END)', 4)} AS mean_difference FROM spec s JOIN {{rows}} r ON r.y <= s.above GROUP BY s.threshold, s.above"""


def design_fields() -> str:
    """Designs of {designs}(id, question, unit, comparison, outcome, decision) that leave a field blank."""
    blank = lambda c: f"CASE WHEN trim(coalesce({c}, '')) = '' THEN '{c} ' ELSE '' END"
    return f"SELECT id, trim(concat({', '.join(blank(c) for c in ('question', 'unit', 'comparison', 'outcome', 'decision'))})) AS missing FROM {{designs}}"


def evidence_manifest(keep: tuple[str, ...] = ()) -> str:
    """Rows of {evidence}(id, status, path, bytes, sha256) and why one is refused; further columns can be kept."""
    return f"SELECT id, status, CASE WHEN status NOT IN ('retrieved', 'unavailable', 'restricted', 'not attempted') THEN 'unknown status' WHEN status = 'retrieved' AND (coalesce(path, '') = '' OR bytes IS NULL OR length(coalesce(sha256, '')) <> 64) THEN 'retrieved files need path, size and hash' END AS rejected{_kept(keep)} FROM {{evidence}}"


def simulation_ledger() -> str:
    """Simulations of {sims}(id, purpose, generator, parameters, n_runs, seed, outcome, guard) that say too little."""
    return "SELECT id, CASE WHEN trim(coalesce(purpose, '')) = '' OR trim(coalesce(generator, '')) = '' OR trim(coalesce(parameters, '')) = '' OR n_runs IS NULL OR n_runs < 1 OR seed IS NULL OR trim(coalesce(outcome, '')) = '' THEN 'incomplete' WHEN trim(coalesce(guard, '')) = '' THEN 'needs what it must not be taken for' END AS rejected FROM {sims}"


def alignment_ledger() -> str:
    """Claims against evidence, {rows}(id, strength, alignment, note), and why a row is refused."""
    return "SELECT id, CASE WHEN strength NOT IN ('strong', 'moderate', 'weak', 'none') THEN 'unknown strength' WHEN alignment NOT IN ('aligned', 'overstated', 'understated', 'inconsistent') THEN 'unknown alignment' WHEN alignment IN ('overstated', 'inconsistent') AND trim(coalesce(note, '')) = '' THEN 'needs a note' END AS rejected FROM {rows}"


def symmetric_limits(center: float = 0.0) -> str:
    """Limits of {values}(v) that lie evenly around a centre."""
    return f"SELECT {num(center)} - max(abs(v - {num(center)})) AS low, {num(center)} + max(abs(v - {num(center)})) AS high FROM {{values}}"


def bubble_areas(most: float = 300.0) -> str:
    """Areas in proportion to {values}(id, v); negative values have none."""
    return f"SELECT id, CASE WHEN v >= 0 THEN {rounded(f'v / nullif(top, {num(0)}) * {num(most)}')} END AS area FROM {{values}} CROSS JOIN (SELECT max(v) AS top FROM {{values}}) t"
