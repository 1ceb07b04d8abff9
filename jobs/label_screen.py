"""Batch job: is a labelled subset of documents fit to speak for all of them?

Four screens over documents and their labels: what is missing where (values and labels by language), the selection from all
documents to labelled ones (kept share, difference of lengths), association of being labelled, and of the label's value, with language
and source, and how far documents of a source are alike in quality (effective number). Their figures are written partitioned by
screen, and so are checks with a status; a run replaces the partitions of the screens that it was asked for and no others.

    python -m jobs.label_screen --documents DOCS --labels LABELS --target FOLDER [--config jobs/label_screen.json]
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvellum.functions.dist import chi2_p
from corvellum.operators import inference, records
from corvellum.plans.sqlplan import apply
from jobs import common

#: Settings and their values where the config file says nothing: screens to run, and limits above which a check warns or fails.
SETTINGS = {"screens": ["missingness", "selection", "association", "clustering"], "missing_warn": 5.0, "missing_fail": 20.0, "smd_warn": 0.1, "smd_fail": 0.25, "alpha": 0.05, "design_effect_warn": 2.0}
FIGURE = ("screen", "subject", "grp", "measure", "value")
VALUES = ("text", "lang", "source", "n_chars", "quality", "toxic")
PAIRS = (("lang", "labelled"), ("source", "labelled"), ("lang", "quality"), ("source", "quality"))


def joined(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document with its label, if it has one. Labels are made one a document first (the least of each value), so labels
    that are repeated don't repeat documents; labels of no document are left out."""
    one = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("toxic").alias("toxic"), F.lit(1).alias("known"))
    return documents.select("doc_id", "text", "lang", "source", "n_chars").join(one, "doc_id", "left").withColumn("labelled", F.coalesce("known", F.lit(0))).drop("known")


def _long(df: DataFrame, subject, grp, *measures: str) -> DataFrame:
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures]))
    return df.select(subject.alias("subject"), grp.cast("string").alias("grp"), cells.alias("c")).select("subject", "grp", "c.*")


def missingness(rows: DataFrame) -> DataFrame:
    """Missing values of each column by language."""
    return _long(apply(inference.missingness(VALUES, "lang"), rows=rows), F.col("col"), F.col("grp"), "n", "missing", "percent")


def selection(rows: DataFrame) -> DataFrame:
    """From all documents to labelled ones."""
    found = apply(inference.funnel("n_chars"), eligible=rows, analysed=rows.where("labelled = 1"))
    return _long(found, F.lit("n_chars"), F.lit(None), *found.columns)


def association(rows: DataFrame) -> DataFrame:
    """Chi-square of pairs of columns; a null of either is left out."""
    found = [apply(inference.chi_square(), rows=rows.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")).select(F.lit(f"{a} x {b}").alias("s"), "chi2", "df") for a, b in PAIRS]
    return _long(reduce(DataFrame.unionByName, found), F.col("s"), F.lit(None), "chi2", "df")


def clustering(rows: DataFrame) -> DataFrame:
    """How alike documents of a source are in quality."""
    found = apply(inference.icc(), rows=rows.where("source IS NOT NULL").select(F.col("source").alias("cluster"), F.col("quality").cast("double").alias("value")))
    return _long(found, F.lit("quality"), F.lit(None), *found.columns)


SCREENS = {"missingness": missingness, "selection": selection, "association": association, "clustering": clustering}


def checks(figures: DataFrame, settings: dict) -> DataFrame:
    """screen, check_name, status and figure for each figure that has a limit; a figure that couldn't be worked out is INFO."""
    wide = figures.groupBy("screen", "subject", "grp").pivot("measure", ["percent", "smd", "chi2", "df", "design_effect"]).agg(F.first("value"))
    wide = wide.withColumn("p", chi2_p(F.when(F.col("df") > 0, F.col("chi2")), F.when(F.col("df") > 0, F.col("df"))))
    figure = {"missingness": F.col("percent"), "selection": F.abs("smd"), "association": F.col("p"), "clustering": F.col("design_effect")}
    over = lambda x, warn, fail: F.when(x > fail, "FAIL").when(x > warn, "WARN").otherwise("PASS")
    status = {
        "missingness": over(figure["missingness"], settings["missing_warn"], settings["missing_fail"]),
        "selection": over(figure["selection"], settings["smd_warn"], settings["smd_fail"]),
        "association": F.when(figure["association"] < settings["alpha"], "WARN").otherwise("PASS"),
        "clustering": F.when(figure["clustering"] > settings["design_effect_warn"], "WARN").otherwise("PASS"),
    }
    pick = lambda of: F.coalesce(*[F.when(F.col("screen") == s, x) for s, x in of.items()])
    name = F.concat_ws(" ", "subject", "grp")
    return wide.select("screen", name.alias("check_name"), pick(figure).alias("figure"), F.when(pick(figure).isNull(), "INFO").otherwise(pick(status)).alias("status"))


def run(spark: SparkSession, documents: str, labels: str, target: str, config: str | None = None) -> dict:
    """Writes figures and checks of the screens in the settings to ``target``; the rating of each screen.

    Null texts, languages, sources and labels count as missing; a null language is a group of its own. Very long texts are
    read whole where missing values are counted, and nowhere else. An empty table gives figures without values.
    """
    settings = common.config(spark, config, SETTINGS)
    if unknown := set(settings["screens"]) - SCREENS.keys():
        raise ValueError(f"unknown screens: {', '.join(sorted(unknown))}")
    docs, known = spark.read.parquet(documents), spark.read.parquet(labels)
    common.log.info("read %d documents of %s and %d labels of %s", docs.count(), documents, known.count(), labels)
    rows = joined(docs, known)
    for screen in settings["screens"]:
        found = SCREENS[screen](rows).withColumn("screen", F.lit(screen)).select(*FIGURE)
        common.replace_partitions(found.coalesce(1), f"{target}/figures", "screen")  # a few rows for each group
    figures = spark.read.parquet(f"{target}/figures").where(F.col("screen").isin(settings["screens"]))
    common.replace_partitions(checks(figures, settings).coalesce(1), f"{target}/checks", "screen")
    judged = spark.read.parquet(f"{target}/checks").where(F.col("screen").isin(settings["screens"]))
    counts = apply(records.status_rollup(), records=judged.select(F.col("screen").alias("grp"), "check_name", "status"))
    rated = apply(records.ratings(), rollup=counts.withColumn("accepted", F.lit(None).cast("string")))
    out = {r.grp: r.rating for r in rated.collect()}
    common.log.info("wrote %d figures and %d checks to %s: %s", figures.count(), judged.count(), target, out)
    return out


if __name__ == "__main__":
    common.command("label_screen", __doc__, {"documents": "Parquet table of documents", "labels": "Parquet table of labels", "target": "folder of the figures and checks"}, run)
