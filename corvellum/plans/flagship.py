"""The flagship: replicate-aware paired comparison of brand volumes between two line statuses."""

from __future__ import annotations

PAIRED_BRAND_EFFECTS = """
WITH cell AS (
  SELECT s_nationkey AS sample, l_linestatus AS condition, p_type AS ptype, p_brand AS feature, l_quantity AS value
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
raw AS (
  SELECT ptype, sample, condition, feature, sum(value) AS total, count(*) AS n FROM cell GROUP BY ptype, sample, condition, feature),
unit AS (
  SELECT ptype, sample, condition FROM raw GROUP BY ptype, sample, condition HAVING sum(n) >= 10),
paired AS (
  SELECT ptype, sample FROM unit GROUP BY ptype, sample HAVING count(*) = 2),
kept_unit AS (
  SELECT u.ptype, u.sample, u.condition FROM unit u JOIN paired p ON u.ptype = p.ptype AND u.sample = p.sample),
feature AS (
  SELECT r.ptype, r.feature FROM raw r JOIN kept_unit u ON r.ptype = u.ptype AND r.sample = u.sample AND r.condition = u.condition
  GROUP BY r.ptype, r.feature HAVING sum(r.total) >= 10 AND count(*) >= 3),
grid AS (
  SELECT u.ptype, u.sample, u.condition, f.feature, coalesce(r.total, CAST(0 AS DOUBLE)) AS total
  FROM kept_unit u JOIN feature f ON u.ptype = f.ptype
  LEFT JOIN raw r ON r.ptype = u.ptype AND r.sample = u.sample AND r.condition = u.condition AND r.feature = f.feature),
logged AS (
  SELECT ptype, sample, condition, feature,
         ln(total * CAST(1000000 AS DOUBLE) / greatest(sum(total) OVER (PARTITION BY ptype, sample, condition), CAST(1 AS DOUBLE)) + CAST(1 AS DOUBLE)) / ln(CAST(2 AS DOUBLE)) AS v
  FROM grid),
pair AS (
  SELECT ptype, feature, sample, sum(CASE WHEN condition = 'O' THEN v ELSE -v END) AS d FROM logged GROUP BY ptype, feature, sample),
test AS (
  SELECT ptype, feature, count(*) AS n_pairs, avg(d) AS m, stddev_samp(d) AS s FROM pair GROUP BY ptype, feature)
SELECT ptype, feature, n_pairs, round(m, 6) AS log2fc,
       round(m / nullif(s / sqrt(CAST(n_pairs AS DOUBLE)), CAST(0 AS DOUBLE)), 6) AS t_stat, n_pairs - 1 AS df
FROM test WHERE n_pairs >= 3
"""
