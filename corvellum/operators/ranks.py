"""Statistics of two rankings of the same rows, step by step.

The text of a ranking reads its relation four times, one inside another sixteen times. Here every step's rows are kept, so
that tables are read once, and all readers of a step see the same sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvellum.functions.sqltext import tied_ranks
from corvellum.operators import inference
from corvellum.operators.structure import kept
from corvellum.plans.sqlplan import apply


def with_rank(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Rows without null values, with their rank ``name``, ties averaged."""
    return apply(f"WITH {tied_ranks('{rows}', value, 'r', 'r')} SELECT {', '.join(rows.columns)}, rk AS {name} FROM r", rows=kept(rows.where(F.col(value).isNotNull())))


def correlations(xy: DataFrame) -> DataFrame:
    """The row of `inference.correlations`."""
    both = xy.select(F.col("x").alias("u"), F.col("y").alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    return apply(inference.both_correlations("{r}"), r=with_rank(with_rank(both, "u", "ru"), "v", "rk"))


def concordance(a: DataFrame, b: DataFrame, alpha: float = 0.05, least: int = 10) -> DataFrame:
    """The row of `inference.concordance`. The terms of the tail, as many as ids called in both at most, are added up by many tasks."""
    pairs = apply(inference.shared_results(alpha), a=a, b=b)
    s = kept(apply(inference.shared_counts("{r}"), r=with_rank(with_rank(pairs, "ea", "ra"), "eb", "rk")))
    told = s.first()
    k = s.sparkSession.range(told.nab, min(told.na, told.nb) + 1).withColumnRenamed("id", "k")
    p = apply(inference.overlap_tail("{t}"), t=k.crossJoin(F.broadcast(s)))
    return apply(inference.agreement("{s} s", "{p} p", least), s=s, p=p)
