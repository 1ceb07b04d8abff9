"""Substring dedup by hashing lines, paragraphs or sentences: the earliest occurrence of each stays, later ones go in runs.

A unit is normalised (A-Z lower-cased, runs of ASCII white space as one space, none at its ends) and hashed; digests are
grouped over all documents, and the earliest occurrence by (document, place) is kept. Neighbouring repeated units of
a document make one run, which has its original offset, length and number of words. All runs are removed, or, for callers
that ask for it, those of ``min_words`` words or more.

A line is cut further at the ends of its sentences unless whole lines or paragraphs are asked for: copied passages often
begin and end inside a line, whose digest is then another one in each document.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvellum.llm.common import chained, short_batches, table, unused

#: Removed runs of so many words are reported as passages. (Of a passage of 50 words that begins and ends inside sentences of its
#: documents, two sentences of about ten words each aren't repeated as a whole.) What is removed doesn't depend on it.
PASSAGE_WORDS = 30
#: Digests that are sent to all tasks at most; they have over one in so many of all repeated units each.
HOT = 10_000
STOPS = ".!?。！？"
#: Patterns that cut a text into units and what lies between, leaving nothing out.
UNITS = {"sentence": rf"[^\n{STOPS}]*[{STOPS}]+|[^\n{STOPS}]+|\n", "line": r"[^\n]+|\n", "paragraph": r"(?:[^\n]|\n(?!\n))+|\n+"}
#: Characters that count as a word each, as their scripts have no spaces: Thai, Japanese and Chinese.
LONE = "฀-๿぀-ヿ㐀-鿿"
_LONE = re.compile(f"[{LONE}]")
_RUN = "struct<start:int,length:int,units:int,words:int,kept_doc_id:bigint,kept_unit:int>"


def units(docs: DataFrame, unit: str = "sentence", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every unit that has a word: doc_id, tid (a digest of the whole text), unit (its number among these), start and
    length in code points, words, and the unit's own 128-bit digest h1, h2."""
    cut = re.compile(UNITS[unit])
    names = ["doc_id", "tid", "unit", "start", "length", "words", "h1", "h2"]

    def run(batches):
        import xxhash

        for batch in batches:
            row, no, start, length, count, digest = [], [], [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                k = 0
                for m in cut.finditer(text or ""):
                    part = m[0]
                    words = part.encode().lower().split()
                    if words:
                        row.append(i), no.append(k), start.append(m.start()), length.append(len(part)), digest.append(xxhash.xxh3_128_digest(b" ".join(words)))
                        count.append(len(words) if part.isascii() else len(words) + len(_LONE.findall(part)))
                        k += 1
            h = np.frombuffer(b"".join(digest), ">i8").astype(np.int64).reshape(-1, 2)
            at = pa.array(row, pa.int64())
            columns = [batch.column(0).take(at), batch.column(1).take(at), *(pa.array(x, pa.int32()) for x in (no, start, length, count)), *(pa.array(np.ascontiguousarray(h[:, j])) for j in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    given = short_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("tid"), F.col(text_col).alias("text"))
    return given.mapInArrow(run, "doc_id long, tid long, unit int, start int, length int, words int, h1 long, h2 long")


def repeated_units(docs: DataFrame, unit: str = "sentence", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Occurrences that aren't the earliest: doc_id, tid, unit, start, length, words, and the earliest one kept_doc_id, kept_unit.

    Occurrences rank by (doc_id, digest of the text, unit), a null doc_id first. Digests are counted with partial
    aggregation, so a unit that a third of all documents share is a few rows by then. Digests that have over one in
    `HOT` of all repeated units, of which there can't be more than `HOT`, travel to the occurrences; occurrences of all
    others meet their earliest one in a shuffle, in which no key is large any more. Null and empty texts have no units.
    Rows that repeat a doc_id with the same text tie and count as one occurrence; with another text they are further
    occurrences. Very long texts are cut whole. Other columns are ignored; an empty table gives no rows.
    """
    u = units(docs, unit, id_col, text_col)
    place = F.struct("doc_id", "tid", "unit")
    first = chained(docs.sparkSession, u.groupBy("h1", "h2").agg(F.min(place).alias("kept"), F.count("*").alias("n")).where("n > 1"))
    most = (first.agg(F.sum("n")).first()[0] or 0) // HOT
    hot = F.broadcast(first.where(F.col("n") > most).where(F.lit(most > 0)).select("h1", "h2", F.col("kept").alias("hot")))
    near = u.join(hot, ["h1", "h2"], "left")
    is_hot = F.col("hot").isNotNull()
    near = near.withColumn("k1", F.when(is_hot, F.xxhash64("doc_id", "tid", "unit")).otherwise(F.col("h1"))).withColumn("k2", F.when(is_hot, F.lit(-1).cast("long")).otherwise(F.col("h2"))).drop("h1", "h2")
    met = near.join(first.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "kept"), ["k1", "k2"], "left").withColumn("kept", F.coalesce("hot", "kept"))
    met = met.where(F.col("kept").isNotNull() & ~place.eqNullSafe(F.col("kept")))
    return met.select("doc_id", "tid", "unit", "start", "length", "words", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.unit").alias("kept_unit"))


def _runs(found: list[dict], min_words: int) -> list[dict]:
    """Neighbouring units as runs, without those of too few words."""
    runs: list[dict] = []
    last = -2
    for u in sorted(found, key=lambda u: u["unit"]):
        if u["unit"] == last + 1:
            runs[-1] |= {"length": u["start"] + u["length"] - runs[-1]["start"], "units": runs[-1]["units"] + 1, "words": runs[-1]["words"] + u["words"]}
        else:
            runs.append({"start": u["start"], "length": u["length"], "units": 1, "words": u["words"], "kept_doc_id": u["kept_doc_id"], "kept_unit": u["kept_unit"]})
        last = u["unit"]
    return [r for r in runs if r["words"] >= min_words]


def remove_repeats(docs: DataFrame, unit: str = "sentence", min_words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, the text without repeated runs, plus n_repeated (units that occur earlier, in short runs
    too) and removed: an array of (start, length, units, words, kept_doc_id, kept_unit) with offsets in the given text.

    What a run spans goes with the white space inside it; what lies around stays as it was. Rows, order of columns
    and null texts stay; a null or empty text, and a table without repeats, lose nothing. A column of the input that has
    the name of a new one gives way to it. Rows that repeat a doc_id with the same text are treated alike: both
    lose what occurs earlier, but not what they only share with each other; with different texts each row loses by its own
    text only. Ties can't occur otherwise, as places differ. Texts are never cut short; one row is one document, so it
    has to fit a task. An empty table stays empty.
    """
    made = ("n_repeated", "removed")
    given = [c for c in docs.columns if c not in made]
    found = repeated_units(docs, unit, id_col, text_col).groupBy("doc_id", "tid")
    left = docs.select(*[docs[f"`{c}`"] for c in given])
    key = unused("found", left)
    found = found.agg(F.collect_set(F.struct("unit", "start", "length", "words", "kept_doc_id", "kept_unit")).alias(key))
    same = left[f"`{id_col}`"].cast("long").eqNullSafe(found["doc_id"]) & (F.xxhash64(left[f"`{text_col}`"]) == found["tid"])
    both = left.join(found, same, "left").select(*[left[f"`{c}`"] for c in given], found[key])
    at = given.index(text_col)

    def run(batches):
        for batch in batches:
            texts, n, removed = [], [], []
            for text, units_found in zip(batch.column(at).to_pylist(), batch.column(len(given)).to_pylist(), strict=True):
                runs = _runs(units_found or [], min_words)
                if runs:
                    ends = [0, *(r["start"] + r["length"] for r in runs)]
                    text = "".join(text[a:b] for a, b in zip(ends, [*(r["start"] for r in runs), len(text)], strict=True))
                texts.append(text), n.append(len(units_found or [])), removed.append(runs)
            columns = [*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(removed, kind)]
            columns[at] = pa.array(texts, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=[*given, *made])

    kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("units", pa.int32()), ("words", pa.int32()), ("kept_doc_id", pa.int64()), ("kept_unit", pa.int32())]))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema.fields] + ["n_repeated long", f"removed array<{_RUN}>"])
    return short_batches(both).mapInArrow(run, schema)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated units: n_repeated units in n_spans runs of n_cut characters, where the first run was and which
    document keeps its earliest occurrence, a digest of what is left; n_removed counts the characters of those runs that are passages."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))
    out = remove_repeats(docs)
    chars = lambda runs: F.aggregate(runs, F.lit(0).cast("long"), lambda s, r: s + r["length"])
    passages = F.filter("removed", lambda r: r["words"] >= PASSAGE_WORDS)
    first = F.get("removed", F.lit(0))
    return out.select(
        "doc_id", "n_chars", "n_repeated", chars("removed").alias("n_cut"), F.size("removed").cast("long").alias("n_spans"), chars(passages).alias("n_removed"),
        first["start"].alias("first_start"), first["kept_doc_id"].alias("first_kept_doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


OP2_SQL = rf"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{UNITS["sentence"]}')) AS x,
         unnest(range(len(regexp_extract_all(coalesce(text, ''), '{UNITS["sentence"]}')))) AS tile FROM documents),
n AS (
  SELECT *, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY tile) - length(x) AS start,
         list_filter(string_split(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), lambda x: x <> '') AS w
  FROM t),
u AS (
  SELECT doc_id, tile, start, length(x) AS length, array_to_string(w, ' ') AS norm,
         len(w) + length(regexp_replace(x, '[^{LONE}]', '', 'g')) AS words,
         row_number() OVER (PARTITION BY doc_id ORDER BY tile) - 1 AS unit
  FROM n WHERE len(w) > 0),
k AS (
  SELECT *, first_value(doc_id) OVER o AS kept_doc_id, first_value(unit) OVER o AS kept_unit FROM u
  WINDOW o AS (PARTITION BY norm ORDER BY doc_id, unit)),
r AS (SELECT *, unit - row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS run FROM k WHERE doc_id <> kept_doc_id OR unit <> kept_unit),
s AS (
  SELECT doc_id, run, min(start) AS a, max(start + length) AS b, count(*) AS units, sum(words) AS words, arg_min(kept_doc_id, unit) AS kept_doc_id
  FROM r GROUP BY doc_id, run),
kept AS (
  SELECT n.doc_id, string_agg(n.x, '' ORDER BY n.tile) AS text
  FROM n WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = n.doc_id AND n.start >= s.a AND n.start < s.b) GROUP BY n.doc_id),
gone AS (
  SELECT doc_id, sum(units) AS n_repeated, sum(b - a) AS n_cut, count(*) AS n_spans, sum(b - a) FILTER (words >= {PASSAGE_WORDS}) AS n_removed,
         min(a) AS first_start, arg_min(kept_doc_id, a) AS first_kept_doc_id FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(length(coalesce(d.text, '')) AS BIGINT) AS n_chars, CAST(coalesce(n_repeated, 0) AS BIGINT) AS n_repeated,
       CAST(coalesce(n_cut, 0) AS BIGINT) AS n_cut, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(first_start AS INTEGER) AS first_start, first_kept_doc_id, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)
"""

QUERIES = {"op2_substring_dedup": op2_substring_dedup}
SQL = {"op2_substring_dedup": OP2_SQL}
