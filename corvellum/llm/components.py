"""Connected components of an edge table by hooking each label to the least one beside it, and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvellum.llm.common import chained


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every id in ``edges`` (a, b), label being the least id it's connected with.

    Labels only fall; each round takes the least label next to an id, then that label's own label, so the number of
    rounds grows with the logarithm of a chain's length. Each round ends at a checkpoint; the driver sees one count.
    Repeated edges, loops and an empty table are fine; rows with a null end are ignored. An id with very many edges is
    one row of labels that a skewed join meets in parts, and minima are taken before rows move.
    """
    spark = edges.sparkSession
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    e = chained(spark, e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = chained(spark, e.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "id"))
    while True:
        near = e.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        low = label.join(near, "id").select("id", "label", F.least("label", "near").alias("low"))
        jump = label.select(F.col("id").alias("low"), F.col("label").alias("far"))
        new = chained(spark, low.join(jump, "low").select("id", "label", F.least("low", "far").alias("new")))
        moved = new.where("new < label").limit(1).count()
        label = new.select("id", F.col("new").alias("label"))
        if not moved:
            return label
