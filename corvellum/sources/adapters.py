"""Adapters of public study layouts: each gives {expr, obs} and the figures a check of it rests on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvellum.operators.sampling import stratified
from corvellum.sources.text import cells_csv, matrix_market, sample_sheet, wide_matrix

ADAPTERS: dict[str, Callable] = {}


def adapter(fn: Callable) -> Callable:
    """Put a reader in the registry under its name."""
    ADAPTERS[fn.__name__] = fn
    return fn


@adapter
def wide_with_sheet(spark: SparkSession, matrix: str, sheet: str, header_starts: str, rows_start: str, wanted: dict[str, str]) -> dict[str, DataFrame]:
    """A wide matrix with a commented sample sheet. A sheet field ``patient_timepoint`` is split at its first '_' into
    time and patient, and what follows a second '_' is kept as the sorted fraction."""
    expr, units, bad = wide_matrix(spark, matrix, label_row=True)
    meta = sample_sheet(spark, sheet, header_starts, rows_start, wanted)
    if "patient_timepoint" in wanted:
        p = F.split("patient_timepoint", "_")
        meta = meta.withColumn("timepoint", p[0]).withColumn("patient", F.get(p, F.lit(1))).withColumn("fraction", F.get(p, F.lit(2)))
    return {"expr": expr, "obs": units.join(meta.withColumnRenamed("id", "unit_id"), "unit_id", "left"), "malformed": spark.createDataFrame([(bad,)], "rows long")}


@adapter
def donor_tables(spark: SparkSession, paths: list[str], id_column: str, label_column: str) -> dict[str, DataFrame]:
    """Units in rows, one file per donor, kept apart by the file's name."""
    expr, obs = cells_csv(spark, paths, id_column, label_column)
    return {"expr": expr, "obs": obs}


@adapter
def libraries(spark: SparkSession, parts: list[tuple[str, list[str], list[str]]], obs: DataFrame, keep: str, share: float | None = None, seed: int = 0) -> dict[str, DataFrame]:
    """MatrixMarket libraries (path, features, units) as one matrix: units that occur in two libraries are left out, only
    rows of ``obs`` (unit_id, state, ...) in the wanted state stay, and a stratified share of them if asked for."""
    expr = None
    for path, features, units in parts:
        one = matrix_market(spark, path, features, units)
        expr = one if expr is None else expr.unionByName(one)
    twice = obs.groupBy("unit_id").agg(F.count("*").alias("n")).where("n > 1").select("unit_id")
    kept = obs.where(F.col("state") == keep).join(twice, "unit_id", "left_anti")
    if share is not None:
        kept = stratified(kept, ["donor", "condition"], "unit_id", share, seed)
    return {"expr": expr.join(kept.select("unit_id"), "unit_id", "left_semi"), "obs": kept}


@adapter
def plates(expr: DataFrame, design: DataFrame, kinds: list[str] | None = None, low: float = 0.1) -> dict[str, DataFrame]:
    """Wells with a design (unit_id, kind, empty boolean): wells missing from it or in it twice are refused, wells said
    to be empty must hold under a tenth of the median total and are dropped; the first symbol before ';' names a feature."""
    wells = expr.select("unit_id").distinct()
    missing = wells.join(design, "unit_id", "left_anti").count()
    double = design.groupBy("unit_id").count().where("count > 1").count()
    if missing or double:
        raise ValueError(f"{missing} wells are not in the design, {double} are in it twice")
    sums = expr.groupBy("unit_id").agg(F.sum("value").alias("total")).join(design, "unit_id", "right").fillna({"total": 0.0})
    mid = sums.agg(F.median(F.when(~F.col("empty"), F.col("total"))).alias("full"), F.median(F.when(F.col("empty"), F.col("total"))).alias("none")).first()
    if mid.none is not None and mid.full is not None and mid.none >= low * mid.full:
        raise ValueError("wells said to be empty are not")
    obs = design.where(~F.col("empty"))
    obs = obs.where(F.col("kind").isin(kinds)) if kinds else obs
    named = expr.withColumn("feature_id", F.trim(F.regexp_replace(F.split("feature_id", ";")[0], '"', "")))
    return {"expr": named.join(obs.select("unit_id"), "unit_id", "left_semi"), "obs": obs}
