"""Deterministic sampling by hashed order, and permutation nulls as rows.

A hash of the seed and the key takes the part of a random stream, so a sample is the same on any cluster.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvellum.functions.sqltext import ranked
from corvellum.operators import enrich, inference
from corvellum.operators.structure import kept
from corvellum.plans.sqlplan import apply


def order_of(seed: int, *keys: str) -> Column:
    """A repeatable random order of rows by their keys."""
    return F.xxhash64(F.lit(seed), *keys)


def halves(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """``df`` with a column half, 0 or 1, by a hash of the key."""
    return df.withColumn("half", F.pmod(order_of(seed, key), F.lit(2)).cast("int"))


def capped(df: DataFrame, key: str, most: int, seed: int = 0) -> DataFrame:
    """At most so many rows, drawn without replacement."""
    return df.orderBy(order_of(seed, key), key).limit(most)


def capped_per_group(df: DataFrame, group: str, key: str, most: int, seed: int = 0) -> DataFrame:
    """At most so many rows of each group."""
    w = Window.partitionBy(group).orderBy(order_of(seed, key), key)
    return df.withColumn("__i__", F.row_number().over(w)).where(F.col("__i__") <= most).drop("__i__")


def stratified(df: DataFrame, strata: list[str], key: str, share: float, seed: int = 0) -> DataFrame:
    """The same share of each stratum, at least one row."""
    w = Window.partitionBy(*strata)
    placed = df.withColumn("__i__", F.row_number().over(w.orderBy(order_of(seed, key), key))).withColumn("__n__", F.count("*").over(w))
    return placed.where(F.col("__i__") <= F.greatest(F.lit(1), F.bround(F.col("__n__") * share))).drop("__i__", "__n__")


#: Standard deviations of a rank by which a permutation's last hash may lie off its expected place.
OFF = 8.0


def permutation_difference(rows: DataFrame, n_perm: int = 1000, seed: int = 0) -> DataFrame:
    """Difference of means of groups 1 and 0 of ``rows`` (id, grp, value), and its two-sided p by relabelling.

    In each permutation as many units as group 1 has, those of the least hashes, are taken for group 1. Hashes are spread
    evenly, so it's known within `OFF` standard deviations where the last of them lies: rows below are added up where they are, and
    only those around that place (by the square root of the rows) are ranked. A permutation for which that doesn't hold, as
    counts tell, is ranked whole, bin by bin. Rows without a value or group are left out; without both groups the
    difference is null.
    """
    spark = rows.sparkSession
    given = rows.where("grp IN (0, 1) AND value IS NOT NULL").select("id", F.col("grp").cast("int").alias("grp"), F.col("value").cast("double").alias("value"))
    facts = given.agg(F.sum("grp").alias("n1"), F.count("*").alias("n"), F.sum("value").alias("total"), F.sum(F.col("grp") * F.col("value")).alias("s1"))
    n1, n = facts.select(F.coalesce("n1", F.lit(0)), "n").first()
    share = n1 / max(n, 1)
    off = OFF * (share * (1 - share) / max(n, 1)) ** 0.5 + 2 * OFF / max(n, 1)
    low, high = (F.lit((min(max(x, 0.0), 1.0) - 0.5) * 2.0**64) for x in (share - off, share + off))
    hashed = lambda perms: given.select("id", "value").repartition(128).crossJoin(F.broadcast(perms)).select("id", "value", "perm", F.xxhash64(F.lit(seed), "perm", "id").cast("double").alias("h"))
    each = hashed(spark.range(n_perm).withColumnRenamed("id", "perm"))
    # a sum for each permutation and task leaves the tasks, and the rows around the place
    below = each.where(F.col("h") < low).groupBy("perm").agg(F.count("*").alias("below"), F.sum("value").alias("s"))
    around = each.where((F.col("h") >= low) & (F.col("h") <= high))
    below = spark.range(n_perm).withColumnRenamed("id", "perm").join(below, "perm", "left").select("perm", F.coalesce("below", F.lit(0)).alias("below"), F.coalesce("s", F.lit(0.0)).alias("s"))
    placed = around.select("perm", "value", F.row_number().over(Window.partitionBy("perm").orderBy("h", "id")).alias("i"))
    taken = placed.join(F.broadcast(below), "perm").groupBy("perm").agg(F.count("*").alias("around"), F.sum(F.when(F.col("i") <= n1 - F.col("below"), F.col("value"))).alias("more"))
    near = kept(below.join(taken, "perm", "left").select("perm", (F.col("s") + F.coalesce("more", F.lit(0.0))).alias("s"), (F.lit(n1).between(F.col("below"), F.col("below") + F.coalesce("around", F.lit(0)))).alias("ok")))
    sums = near.where("ok").select("perm", "s")
    astray = near.where("NOT ok").select("perm")
    if astray.limit(1).count():
        apart = spark.sql(f"WITH {ranked('{x}', 'h', 'id', 'perm')} SELECT k.perm, k.value, k.i FROM k", x=hashed(astray))
        sums = sums.unionByName(apart.where(F.col("i") <= n1).groupBy("perm").agg(F.sum("value").alias("s")))
    sums = sums.crossJoin(F.broadcast(facts)).where("n1 > 0")
    mean = lambda s, n: F.try_divide(s, n.cast("double"))
    null = sums.select((mean(F.col("s"), F.col("n1")) - mean(F.col("total") - F.col("s"), F.col("n") - F.col("n1"))).alias("x"), (mean(F.col("s1"), F.col("n1")) - mean(F.col("total") - F.col("s1"), F.col("n") - F.col("n1"))).alias("d"))
    as_far = F.sum((F.abs("x") >= F.abs("d") - 1e-12).cast("int"))
    return null.groupBy(F.col("d").alias("difference")).agg(((as_far + 1) / (F.count("*") + 1)).alias("p"))


def swapped_labels(units: DataFrame, n_swaps: int = 20, seed: int = 0, paired: bool = True) -> DataFrame:
    """(swap, sample, flip) of paired samples: for each swap a hashed coin per sample; swaps that flip none or all are
    left out. For samples of one condition each, over (sample, condition): labels dealt anew, as many of each as there were;
    swaps that leave all where they were, or change all, are left out."""
    s = units.select("sample", *([] if paired else ["condition"])).distinct().withColumn("swap", F.explode(F.sequence(F.lit(1), F.lit(n_swaps))))
    coin = F.xxhash64(F.lit(seed), "swap", "sample")
    w = Window.partitionBy("swap")
    if paired:
        s = s.withColumn("flip", F.pmod(coin, F.lit(2)) == 1)
    else:
        first = F.col("condition") == F.min("condition").over(w)
        s = s.withColumn("is_first", first).withColumn("place", F.row_number().over(w.orderBy(coin, "sample")))
        s = s.withColumn("flip", F.col("is_first") != (F.col("place") <= F.sum(F.col("is_first").cast("int")).over(w)))
    k, n = F.sum(F.col("flip").cast("int")).over(w), F.count("*").over(w)
    return s.withColumn("k", k).withColumn("n", n).where("k > 0 AND k < n").select("swap", "sample", "flip")


def swap_null(logs: DataFrame, units: DataFrame, ref: str, test: str, paired: bool = True, n_swaps: int = 20, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Features called at ``alpha`` after Benjamini-Hochberg under swapped condition labels, one row per (ptype, swap): called, tested.

    ``logs`` (ptype, sample, condition, feature, v) without zeros and ``units`` (ptype, sample, condition) are tested by
    `designs.effects` with the labels of each swap, so the null is that of the test itself. Labels are swapped within samples of a
    paired design, else between samples. Nothing that could be swapped gives no rows. The labels of the swaps are a row for each sample and
    swap; logs meet them in a join that sends them along if they are small.
    """
    from corvellum.functions.dist import t_p
    from corvellum.operators import designs
    from corvellum.plans.sqlplan import apply

    swaps = swapped_labels(units, n_swaps, seed, paired)
    other = F.when(F.col("condition") == ref, F.lit(test)).otherwise(F.lit(ref))

    def under(df: DataFrame) -> DataFrame:
        key = F.concat_ws("\u0001", "ptype", F.col("swap").cast("string"))
        return df.join(swaps, "sample").select(key.alias("ptype"), "sample", F.when(F.col("flip"), other).otherwise(F.col("condition")).alias("condition"), *[c for c in df.columns if c not in ("ptype", "sample", "condition")])

    gate = logs.sparkSession.createDataFrame([(paired,)], "paired boolean")
    found = apply(designs.effects(ref, test), logs=under(logs), kept=under(units), gate=gate).where("t_stat IS NOT NULL").withColumn("p", t_p(F.col("t_stat"), F.col("df")))
    w = Window.partitionBy("ptype")
    r = found.withColumn("i", F.row_number().over(w.orderBy("p", "feature"))).withColumn("t", F.count("*").over(w))
    q = r.withColumn("q", F.min(F.col("p") * F.col("t") / F.col("i")).over(w.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.split("ptype", "\u0001")
    return q.groupBy("ptype").agg(F.sum((F.col("q") < alpha).cast("int")).alias("called"), F.count("*").alias("tested")).select(parts[0].alias("ptype"), parts[1].cast("int").alias("swap"), "called", "tested")


#: Features that a ranked list may have: each list travels to the tasks as one array of doubles.
LONGEST_LIST = 2_000_000
#: Null scores that one task draws together.
CHUNK = 50


def size_class(size: Column, n: Column) -> Column:
    """Set sizes on a logarithmic grid of eight steps a decade, so that alike sizes share a null."""
    step = F.round(F.pow(F.lit(10.0), F.round(F.log10(size) * 8) / 8))
    return F.least(F.greatest(step, F.lit(2.0)), (n - 1).cast("double")).cast("long")


def enrichment_null(lists: DataFrame, classes: DataFrame, n_perm: int = 1500, seed: int = 0) -> DataFrame:
    """(grp, k, es): ``n_perm`` absolute null scores of random sets of each size class k of ``classes`` (grp, k), over
    ``lists`` (grp, weights): the absolute statistics of a group, the highest statistic first.

    A task draws `CHUNK` scores of one class with its own numpy stream, so results don't depend on how tasks are laid out.
    """
    chunks = classes.sparkSession.range(-(-n_perm // CHUNK)).withColumnRenamed("id", "chunk")
    work = classes.join(lists, "grp").join(F.broadcast(chunks)).repartition(64, "grp", "k", "chunk")

    def run(batches):
        for frame in batches:
            for grp, k, chunk, weights in zip(frame["grp"], frame["k"], frame["chunk"], frame["weights"], strict=True):
                w, rng = np.asarray(weights, float), np.random.default_rng([seed, int(k), int(chunk), *str(grp).encode()])
                n, out = len(w), []
                for _ in range(min(CHUNK, n_perm - int(chunk) * CHUNK)):
                    at = np.sort(rng.choice(n, int(k), replace=False))
                    step = w[at] / max(w[at].sum(), 1e-12)
                    after = np.cumsum(step) - (at - np.arange(len(at))) / max(n - len(at), 1)
                    out.append(max(after.max(), -(after - step).min()))
                yield pd.DataFrame({"grp": grp, "k": int(k), "es": out})

    return work.select("grp", "k", "chunk", "weights").mapInPandas(run, "grp string, k long, es double")


def enrichment(ranked: DataFrame, sets: DataFrame, n_perm: int = 1500, min_overlap: int = 10, seed: int = 0, extend_tail: bool = False) -> DataFrame:
    """Pre-ranked enrichment of ``sets`` (term, feature_id) along ``ranked`` (grp, feature_id, stat), in each group: grp,
    term, size, es, nes, p, fdr over the group's terms, place by p.

    p is the share of null scores of the size class as extreme; where that is too coarse (under 20 of the null), the tail
    beyond the null's 90 % quantile is taken as exponential, if ``extend_tail`` is on; otherwise no p is below one over the number of draws and one.
    """
    scores = apply(enrich.running_score_by(min_overlap), ranked=ranked, sets=sets).withColumn("k", size_class(F.col("size").cast("double"), F.col("n"))).persist()
    long = scores.agg(F.max("n")).first()[0] or 0
    if long > LONGEST_LIST:
        raise ValueError(f"a ranked list has {long} features, over {LONGEST_LIST}")
    one = ranked.where("stat IS NOT NULL").groupBy("grp", F.upper("feature_id").alias("f")).agg(F.max("stat").alias("stat"))
    lists = one.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("stat")).alias("s"), "f"))), lambda x: F.abs(x["s"])).alias("weights"))
    null = enrichment_null(lists, scores.select("grp", "k").distinct(), n_perm, seed).persist()
    shape = null.groupBy("grp", "k").agg(F.avg("es").alias("mean"), F.percentile("es", F.lit(0.9)).alias("q"), F.count("*").alias("perms"))
    over = null.join(shape, ["grp", "k"]).where("es > q").groupBy("grp", "k").agg(F.avg(F.col("es") - F.col("q")).alias("excess"), F.count("*").alias("beyond"))
    p = scores.join(null.select("grp", "k", F.col("es").alias("x")), ["grp", "k"]).groupBy("grp", "term", "size", "k", "es").agg(F.sum((F.col("x") >= F.abs("es")).cast("long")).alias("as_far"))
    p = p.join(shape, ["grp", "k"]).join(over, ["grp", "k"], "left")
    share = (F.col("as_far") + 1) / (F.col("perms") + 1)
    tail = F.greatest(F.lit(0.1) * F.exp(-(F.abs("es") - F.col("q")) / F.col("excess")), F.lit(1e-12))
    coarse = (share < F.lit(20.0) / (F.col("perms") + 1)) & (F.col("beyond") >= 10) & (F.abs("es") > F.col("q")) & (F.col("excess") > 0) & F.lit(extend_tail)
    p = p.select("grp", "term", "size", "es", (F.col("es") / F.greatest("mean", F.lit(1e-12))).alias("nes"), F.when(coarse, F.least(share, tail)).otherwise(share).alias("p"))
    p = p.withColumn("id", F.concat_ws("\u0001", "grp", "term")).persist()
    fdr = apply(inference.multiplicity("grp"), p=p.select("id", "grp", "p")).select("id", F.col("bh").alias("fdr"))
    w = Window.partitionBy("grp").orderBy("p", "term")
    return p.join(fdr, "id").withColumn("place", F.row_number().over(w)).drop("id")
