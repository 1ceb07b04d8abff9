"""From raw documents to token ids: quality rules, line dedup, near-dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept; all but the last return the columns
of ``documents``. `run` writes each stage's result as Parquet in the shared folder and reads it again for the next, so a
lost executor costs one stage's work and no plan spans two stages.

What the stages do with odd rows is what their operators say. In short: a null or empty text fails the quality rules; rows
that repeat a doc_id are judged, cut and encoded each by its own text, but near-dedup takes them as one document; rows
with a null doc_id pass line dedup and near-dedup untouched; very long texts are treated whole; further columns pass
through all stages but the last, which leaves out those that have the name of one it makes; an empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvellum.llm.common import shared_folder, table
from corvellum.llm.decontaminate import drop_leaks
from corvellum.llm.line_templates import drop_recurring_lines
from corvellum.llm.order_minhash import keep_one_of_each
from corvellum.llm.pieces import encode_documents
from corvellum.llm.quality import keep_good, trusted_documents

#: Not SQL: hashes, sketches, alignments and merges have no counterpart there; tests compare with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose heuristics and log-likelihood ratio are good enough; the others go, null and empty texts too."""
    return keep_good(docs, trusted_documents(spark, sf_dir))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of recurring templates but in the first document that has each, so that of a text
    with many near copies one keeps its lines; ``n_chars`` (if there is one) follows the text, a null text has none."""
    out = drop_recurring_lines(docs, keep_first=True)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the least doc_id; rows without a doc_id stay."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, with digests of the ids and of the text decoded from them."""
    return encode_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
