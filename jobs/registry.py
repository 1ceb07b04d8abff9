"""The jobs as queries: each runs twice into one new folder and returns the whole output as it stands after the second run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corvellum.sources.files import shared_folder
from jobs import evidence_manifest, label_screen


def job1_evidence_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all pages; the second run finds nothing new."""
    folder = f"{shared_folder(spark)}/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        evidence_manifest.run(spark, f"{sf_dir}/pages.parquet", f"{folder}/manifest", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/manifest").select(*evidence_manifest.COLUMNS)


def job2_label_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All figures of all screens; the second run replaces them by the same."""
    folder = f"{shared_folder(spark)}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        label_screen.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", folder)
    return spark.read.parquet(f"{folder}/figures").select(*label_screen.FIGURE)


_MANIFEST_SQL = """
WITH p AS (
  SELECT page_id, url, lower(url) AS u, CASE WHEN coalesce(html, '') <> '' THEN html END AS html FROM pages),
r AS (
  SELECT *, CASE WHEN regexp_matches(u, '[.](fastq|fq|fastq[.]gz|fq[.]gz|sra|bam|cram)$') THEN 'raw_reads'
    WHEN regexp_matches(u, 'series_matrix|metadata|pheno|sample_info|samples|sdrf|design') THEN 'sample_metadata'
    WHEN regexp_matches(u, 'count|matrix|expression|tpm|fpkm|rpkm|[.]h5|[.]mtx|normalized') THEN 'processed_matrix'
    WHEN regexp_matches(u, '[.](py|r|rmd|ipynb|sh|smk)$|snakefile') THEN 'code' ELSE 'unknown' END AS role,
    min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id AS evidence_id, url AS name, role, CASE WHEN html IS NULL THEN 'unavailable' ELSE 'retrieved' END AS status, CAST(strlen(html) AS BIGINT) AS bytes, sha256(html) AS sha256,
       CASE WHEN html IS NOT NULL AND coalesce(url, '') = '' THEN 'retrieved files need path, size and hash' END AS rejected,
       CASE WHEN html IS NOT NULL AND first <> page_id THEN first END AS copy_of
FROM r
"""


def _screen_sql() -> str:
    gone = lambda c: f"({c} IS NULL OR {c}::VARCHAR IN ('', 'NA', 'NaN', 'nan', 'NULL', 'null', 'N/A'))"
    missing = " UNION ALL ".join(
        f"SELECT '{c}' AS subject, lang AS grp, unnest(['n', 'missing', 'percent']) AS measure, unnest([count(*)::DOUBLE, (count(*) FILTER {gone(c)})::DOUBLE, round(100.0::DOUBLE * (count(*) FILTER {gone(c)}) / count(*), 3)]) AS value FROM d GROUP BY lang"
        for c in label_screen.VALUES
    )
    pairs = " UNION ALL ".join(f"SELECT '{a} x {b}' AS s, {a}::VARCHAR AS a, {b}::VARCHAR AS b FROM d WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in label_screen.PAIRS)
    return f"""
WITH l AS (SELECT doc_id, min(quality) AS quality, min(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT d.*, l.quality, l.toxic, CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END AS labelled FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id),
m AS ({missing}),
f AS (SELECT count(*)::DOUBLE AS eligible, (count(*) FILTER (labelled = 1))::DOUBLE AS analysed, avg(n_chars) AS me, avg(n_chars) FILTER (labelled = 1) AS ma,
        median(n_chars) AS de, median(n_chars) FILTER (labelled = 1) AS da, stddev_samp(n_chars) AS s FROM d),
sel AS (SELECT 'n_chars' AS subject, NULL::VARCHAR AS grp, unnest(['eligible', 'analysed', 'kept_percent', 'mean_eligible', 'mean_analysed', 'median_eligible', 'median_analysed', 'smd']) AS measure,
        unnest([eligible, analysed, round(100 * analysed / eligible, 3), round(me, 6), round(ma, 6), round(de, 6), round(da, 6), round((ma - me) / nullif(s, 0), 6)]) AS value FROM f),
x AS ({pairs}),
o AS (SELECT s, a, b, count(*)::DOUBLE AS n FROM x GROUP BY s, a, b),
ra AS (SELECT s, a, sum(n) AS n FROM o GROUP BY s, a), rb AS (SELECT s, b, sum(n) AS n FROM o GROUP BY s, b),
k AS (SELECT s, (SELECT count(*) FROM ra WHERE ra.s = t.s) AS ka, (SELECT count(*) FROM rb WHERE rb.s = t.s) AS kb, sum(n) AS n FROM o t GROUP BY s),
c AS (SELECT k.s, any_value((ka - 1) * (kb - 1))::DOUBLE AS df, sum(power(CASE WHEN ka = 2 AND kb = 2 THEN greatest(abs(coalesce(o.n, 0) - ra.n * rb.n / k.n) - 0.5, 0) ELSE abs(coalesce(o.n, 0) - ra.n * rb.n / k.n) END, 2) / (ra.n * rb.n / k.n)) AS chi2
      FROM k JOIN ra ON ra.s = k.s JOIN rb ON rb.s = k.s LEFT JOIN o ON o.s = k.s AND o.a = ra.a AND o.b = rb.b GROUP BY k.s),
a AS (SELECT s AS subject, NULL::VARCHAR AS grp, unnest(['chi2', 'df']) AS measure, unnest([round(chi2, 6), df]) AS value FROM c),
g AS (SELECT source, count(quality)::DOUBLE AS n, avg(quality) AS mean, var_pop(quality) * count(quality) AS ss FROM d WHERE source IS NOT NULL AND quality IS NOT NULL GROUP BY source),
t AS (SELECT count(*)::DOUBLE AS k, sum(n) AS n, sum(n * n) AS n2, sum(n * mean) / sum(n) AS mean, sum(ss) AS ssw FROM g),
v AS (SELECT t.k, t.n, (SELECT sum(g.n * (g.mean - t.mean) * (g.mean - t.mean)) FROM g) / (t.k - 1) AS msb, t.ssw / (t.n - t.k) AS msw, (t.n - t.n2 / t.n) / (t.k - 1) AS n0 FROM t),
i AS (SELECT k, n, (msb - msw) / (msb + (n0 - 1) * msw) AS icc FROM v),
e AS (SELECT 'quality' AS subject, NULL::VARCHAR AS grp, unnest(['icc', 'design_effect', 'effective_n']) AS measure, unnest([round(icc, 6), round(1 + (n / k - 1) * icc, 6), round(n / (1 + (n / k - 1) * icc), 6)]) AS value FROM i)
SELECT 'missingness' AS screen, * FROM m UNION ALL SELECT 'selection', * FROM sel UNION ALL SELECT 'association', * FROM a UNION ALL SELECT 'clustering', * FROM e
"""


QUERIES = {"job1_evidence_manifest": job1_evidence_manifest, "job2_label_screen": job2_label_screen}
SQL = {"job1_evidence_manifest": _MANIFEST_SQL, "job2_label_screen": _screen_sql()}
