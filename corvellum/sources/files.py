"""Files of any store that Spark can reach, through its own readers and its Hadoop file system."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _opened(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines of the cluster share, as ``spark.checkpoint.dir`` names it; a local session without one gets a
    temporary folder, which would be another one on each machine of a cluster, so it's an error there."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return named or tempfile.mkdtemp(prefix="corvellum-shared-")


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _opened(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or a folder with all that's in it, if there is one."""
    fs, p = _opened(spark, path)
    fs.delete(p, True)


def listing(spark: SparkSession, path: str) -> str:
    """Names, lengths and times of the files of a folder as one line; empty if there is no folder."""
    fs, p = _opened(spark, path)
    if not fs.exists(p):
        return ""
    found, it = [], fs.listFiles(p, True)
    while it.hasNext():
        s = it.next()
        found.append(f"{s.getPath().toUri().getPath()} {s.getLen()} {s.getModificationTime()}")
    return "\n".join(sorted(found))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small text file, in place of what was there."""
    fs, p = _opened(spark, path)
    out = fs.create(p, True)
    try:
        out.write(text.encode())
    finally:
        out.close()


def content_digest(df: DataFrame) -> str:
    """A digest of the rows of a table, whatever their order and files: their number, and the sum and exclusive-or of
    their hashes. Names and types of the columns take part."""
    row = F.xxhash64(F.lit(df.schema.simpleString()), *[F.col(f"`{c}`") for c in sorted(df.columns)])
    d = df.select(row.alias("h")).agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("h").alias("x")).first()
    return f"{d.n}:{d.s}:{d.x}"
