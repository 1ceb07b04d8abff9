"""One declarative text for both engines: Catalyst plans it over Parquet, DuckDB checks the result.

An operator is a function that returns SQL with named relations in braces, ``{x}``. On DataFrames it is run by
`apply`; a registered query fills the braces with subqueries over the driver's tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# The same function under its name in Spark and in DuckDB.
_DUCK = {"percentile(": "quantile_cont(", "bround(": "round_even(", "collect_list(": "list(", "startswith(": "starts_with(", "endswith(": "ends_with(", "max_by(": "arg_max(", "min_by(": "arg_min(", "explode(sequence(": "unnest(generate_series("}


def duck(text: str) -> str:
    """The text as DuckDB says it."""
    for ours, theirs in _DUCK.items():
        text = re.sub(rf"\b{re.escape(ours)}", theirs, text)
    text = re.sub(r"\bsha2\((\w+), 256\)", r"sha256(\1)", text)
    return re.sub(r"(\w+) RLIKE ('[^']*')", lambda m: f"regexp_matches({m[1]}, {m[2]})".replace("\\\\", "\\"), text)


def fill(op: str, **relations: str) -> str:
    """The operator's text over subqueries."""
    for name, text in relations.items():
        op = op.replace(f"{{{name}}}", f"({text})")
    return op


def apply(op: str, **frames: DataFrame) -> DataFrame:
    """The operator over DataFrames; no name is left in the session's catalogue."""
    session = next(iter(frames.values())).sparkSession
    return session.sql(op, **frames)


def tables_in(text: str) -> list[str]:
    """The driver's tables that a query reads."""
    named = set(re.findall(r"(?:FROM|JOIN|,)\s+(\w+)", text))
    return [t for t in TABLES if t in named]


def from_sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query function for ``text``, whose table names are read from the given folder."""
    used = tables_in(text)
    open_text = text
    for t in used:
        open_text = re.sub(rf"((?:FROM|JOIN|,)\s+){t}\b", rf"\1{{{t}}} AS {t}", open_text)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(open_text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})

    return run
