"""What the jobs' command lines share: config files read through Spark, logging, a session for the length of a run."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("jobs")


def config(spark: SparkSession, path: str | None, known: dict) -> dict:
    """``known`` with what a JSON file, of any store, says otherwise; a key that isn't known is an error."""
    given = json.loads(spark.read.text(path, wholetext=True).first()[0]) if path else {}
    if unknown := given.keys() - known.keys():
        raise ValueError(f"unknown settings in {path}: {', '.join(sorted(unknown))}")
    return known | given


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet folder, or None as long as there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Writes ``df`` partitioned by columns; partitions that it has are replaced, all others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def command(name: str, doc: str, paths: dict[str, str], run: Callable[..., dict]) -> None:
    """Runs ``run(spark, *paths, settings)`` in a session of its own."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=doc)
    for path, what in paths.items():
        parser.add_argument(f"--{path}", required=True, help=what)
    parser.add_argument("--config", help="JSON file of settings")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        log.info("done: %s", json.dumps(run(spark, *(getattr(args, p) for p in paths), args.config)))
    finally:
        spark.stop()
