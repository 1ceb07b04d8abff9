"""Incremental job: a manifest of the evidence that a review has retrieved.

Retrieved pages arrive as Parquet files in a folder. Each page gets one row: its address, size, digest, role by the address's words,
whether it was retrieved, why the manifest refuses it if it does, and the first evidence with the same content if there is an
earlier one. A file stream with a checkpoint takes only files that no earlier run took, and then ends; what a batch finds is
compared with the digests already in the manifest, so old pages are never read again. Output is partitioned by batch and
role; a batch that is repeated after a failure replaces its own partitions and leaves all others alone.

    python -m jobs.evidence_manifest --source PAGES --target MANIFEST --checkpoint FOLDER [--config jobs/evidence_manifest.json]
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvellum.operators import records
from corvellum.plans.sqlplan import apply
from jobs import common

#: Settings and their values where the config file says nothing: columns of the source, and files of a batch (0: all new ones).
SETTINGS = {"id": "page_id", "name": "url", "content": "html", "files_per_batch": 0}
COLUMNS = ("evidence_id", "name", "role", "status", "bytes", "sha256", "rejected", "copy_of")


def described(pages: DataFrame, settings: dict) -> DataFrame:
    """evidence_id, name, role, status, bytes, sha256 and rejected of each page.

    Null or empty content is evidence that is unavailable: it has no size and no digest. A null or blank name is refused by
    the manifest's rule. Repeated rows each have their row; other columns are ignored; an empty table gives no rows.
    """
    content = F.col(f"`{settings['content']}`")
    there = F.coalesce(F.length(content), F.lit(0)) > 0
    rows = pages.select(
        F.col(f"`{settings['id']}`").alias("id"), F.col(f"`{settings['name']}`").alias("name"), F.when(there, "retrieved").otherwise("unavailable").alias("status"),
        F.when(there, F.octet_length(content).cast("long")).alias("bytes"), F.when(there, F.sha2(content, 256)).alias("sha256"),
    )
    roles = apply(records.file_roles(("id", "status", "bytes", "sha256")), files=rows)
    judged = apply(records.evidence_manifest(("path", "role", "bytes", "sha256")), evidence=roles.withColumnRenamed("name", "path"))
    return judged.select(F.col("id").alias("evidence_id"), F.col("path").alias("name"), "role", "status", "bytes", "sha256", "rejected")


def with_copies(new: DataFrame, known: DataFrame | None) -> DataFrame:
    """``new`` with copy_of: the first evidence of the same content, which is that of ``known`` (sha256, evidence_id) or the least id
    among the new ones; null for the first one itself and where there is no content. Minima are taken before rows move,
    so content that very many pages share is a few rows by then."""
    here = new.where("sha256 IS NOT NULL").groupBy("sha256").agg(F.min("evidence_id").alias("here"))
    if known is not None:
        here = here.join(known.groupBy("sha256").agg(F.min("evidence_id").alias("before")), "sha256", "left")
        here = here.select("sha256", F.coalesce("before", "here").alias("first"))
    first = here.toDF("sha256", "first")
    copy = F.when(F.col("first") != F.col("evidence_id"), F.col("first"))
    return new.join(first, "sha256", "left").withColumn("copy_of", copy).select(*COLUMNS)


def as_pattern(path: str) -> str:
    """A pattern that only ``path`` fits: a file stream takes a folder or a pattern, and a table may be one file."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, source: str, target: str, checkpoint: str, config: str | None = None) -> dict:
    """Takes the files of ``source`` that are new to ``checkpoint`` into the manifest at ``target``; counts of what it did."""
    settings = common.config(spark, config, SETTINGS)
    done = {"batches": 0, "rows": 0, "retrieved": 0, "refused": 0, "copies": 0}

    def record(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        before = common.stored(session, target)
        known = before.where((F.col("batch") < number) & F.col("sha256").isNotNull() & F.col("copy_of").isNull()).select("sha256", "evidence_id") if before is not None else None
        rows = with_copies(described(batch, settings), known)
        common.replace_partitions(rows.withColumn("batch", F.lit(number).cast("long")), target, "batch", "role")
        seen = session.read.parquet(target).where(F.col("batch") == number)
        n = seen.agg(F.count("*").alias("rows"), F.count_if(F.col("status") == "retrieved").alias("retrieved"), F.count("rejected").alias("refused"), F.count("copy_of").alias("copies")).first().asDict()
        common.log.info("batch %d of %s: %s rows into %s, %s", number, source, n["rows"], target, n)
        done["batches"] += 1
        for k, v in n.items():
            done[k] += v

    stream = spark.readStream.schema(spark.read.parquet(source).schema)
    if settings["files_per_batch"]:
        stream = stream.option("maxFilesPerTrigger", settings["files_per_batch"])
    query = stream.parquet(as_pattern(source)).writeStream.foreachBatch(record).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    common.log.info("%s: %d new batches with %d rows", source, done["batches"], done["rows"])
    return done


if __name__ == "__main__":
    common.command("evidence_manifest", __doc__, {"source": "folder of Parquet files of pages", "target": "folder of the manifest", "checkpoint": "folder of the stream's progress"}, run)
