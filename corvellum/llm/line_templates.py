"""Line dedup by a log-template tree of fixed depth, in DataFrame functions.

A line's leaf is found by its number of tokens and its first `LEAD` tokens, tokens with a digit being a variable field
``<*>``. A leaf holds several templates, one for each of its cells: the whole leaf, and, for each of `BANDS` pairs of
places, the lines that have the same tokens there. The most frequent form of a cell is its seed; the lines of the cell
with at least `SIMILAR` of their tokens in common with it are one template, in which the places where they differ are
fields. A template found in `MIN_DOCS` or more different texts recurs, and its lines are dropped, in all documents or in
all but the first. Whole copies of a text count once, so a copied document doesn't make its own lines recur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvellum.llm.common import chained, table, unused

LEAD, SIMILAR, MIN_DOCS, BANDS = 3, 0.7, 5, 6
FIELD = "<*>"


def _tokens(line: Column) -> Column:
    """Tokens of a line; other white space than blanks is rare, and splitting at one character is fast."""
    x = F.when(line.rlike(r"[\t\x0B-\r]"), F.regexp_replace(line, r"[\t\x0B-\r]", " ")).otherwise(line)
    return F.array_remove(F.split(x, " "), "")


def _masked(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), FIELD).otherwise(t))


def _leaf(tokens: Column) -> Column:
    return F.xxhash64(F.size(tokens), _masked(F.slice(tokens, 1, LEAD)))


def _places(band: int, size: Column) -> tuple[Column, Column]:
    """The two places (from 0 on) that a band looks at in lines of ``size`` tokens."""
    return F.pmod(F.lit(LEAD + 2 * band), size), F.pmod(F.lit(LEAD + 1 + 5 * band) + F.floor(size / 2).cast("int"), size)


def _cells(masked: Column) -> Column:
    """Cells of a line within its leaf, band 0 being the whole leaf."""
    n = F.size(masked)
    at = [_places(b, n) for b in range(1, BANDS + 1)]
    return F.array(F.lit(0).cast("long"), *[F.xxhash64(F.lit(b), F.get(masked, x), F.get(masked, y)) for b, (x, y) in enumerate(at, 1)])


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tid, text): texts, null ones as empty, with a digest."""
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("tid"), F.coalesce(text, F.lit("")).alias("text"))


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines to drop: one row per document that has some: doc_id, tid (digest of its text), dropped array<int> (line
    numbers, ascending).

    Leaves with too few lines go first, as counts with partial aggregation; only documents that have lines in the
    rest send their text to them. From then on forms (different masked lines of a leaf) are counted, not lines, and cells
    with too few lines go before any form meets a seed. A hot leaf or form is one row of statistics, which a
    skewed join meets in parts. Empty and null texts have no lines; texts of any length are cut whole. Rows that repeat
    a doc_id count as one document, each with its own text's lines; rows with a null doc_id keep their lines. Ties for the
    seed go to the greater line in code point order. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    d = _documents(docs, id_col, text_col)
    placed = d.select("doc_id", "tid", F.posexplode(F.split("text", "\n")).alias("line", "x")).withColumn("a", _tokens(F.col("x"))).where(F.size("a") > 0)
    placed = chained(spark, placed.select("doc_id", "tid", "line", _leaf(F.col("a")).alias("leaf")))
    busy = placed.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("leaf")
    at = placed.join(busy, "leaf", "left_semi").groupBy("doc_id", "tid").agg(F.collect_set("line").alias("at"))
    lines = d.join(at, ["doc_id", "tid"]).select("doc_id", "tid", "at", F.posexplode(F.split("text", "\n")).alias("line", "x"))
    lines = lines.where(F.array_contains("at", F.col("line"))).select("doc_id", "tid", "line", _tokens(F.col("x")).alias("a"))
    lines = lines.select("doc_id", "tid", "line", _leaf(F.col("a")).alias("leaf"), F.array_join(_masked(F.col("a")), " ").alias("masked"))
    lines = chained(spark, lines.withColumn("form", F.xxhash64("masked")))
    forms = chained(spark, lines.groupBy("leaf", "form").agg(F.count("*").alias("n"), F.first("masked").alias("masked")))
    in_cells = forms.select("leaf", "form", "n", "masked", F.posexplode(_cells(F.split("masked", " "))).alias("band", "cell"))
    seeds = in_cells.groupBy("leaf", "band", "cell").agg(F.sum("n").alias("lines"), F.max(F.struct("n", "masked"))["masked"].alias("seed")).where(F.col("lines") >= min_docs)
    met = in_cells.join(seeds.select("leaf", "band", "cell", "seed"), ["leaf", "band", "cell"])
    a, b = F.split("masked", " "), F.split("seed", " ")
    alike = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) >= SIMILAR * F.size(a)
    tagged = met.where((F.col("masked") == F.col("seed")) | alike).groupBy("leaf", "form").agg(F.collect_set(F.struct("band", "cell")).alias("cells"))
    tagged = lines.drop("masked").join(tagged, ["leaf", "form"]).select("doc_id", "tid", "line", "leaf", F.explode("cells").alias("c")).select("doc_id", "tid", "line", "leaf", "c.band", "c.cell")
    texts = tagged.groupBy("leaf", "band", "cell", "tid").agg(F.min("doc_id").alias("first"))
    recurring = texts.groupBy("leaf", "band", "cell").agg(F.count("*").alias("n"), F.min("first").alias("first")).where(F.col("n") >= min_docs)
    gone = tagged.join(recurring.select("leaf", "band", "cell", "first"), ["leaf", "band", "cell"])
    gone = gone.where(F.col("doc_id") != F.col("first") if keep_first else F.col("doc_id").isNotNull())
    return gone.groupBy("doc_id", "tid").agg(F.array_sort(F.collect_set("line")).alias("dropped"))


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines of `recurring_lines`; every document stays, null texts stay null, columns of any name too."""
    gone = recurring_lines(docs, min_docs, keep_first, id_col, text_col)
    key = unused("dropped", docs)
    gone = gone.select(F.col("doc_id").alias(unused("id", docs)), F.col("tid").alias(unused("tid", docs)), F.col("dropped").alias(key))
    a = docs.join(gone, (docs[f"`{id_col}`"] == gone[gone.columns[0]]) & (F.xxhash64(docs[f"`{text_col}`"]) == gone[gone.columns[1]]), "left")
    stay = F.filter(F.split(F.col(f"`{text_col}`"), "\n"), lambda x, i: ~F.array_contains(F.col(key), i))
    text = F.when(F.col(key).isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(stay, "\n"))
    return a.withColumn(text_col, text).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dropped lines of all documents, one row each."""
    out = recurring_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.explode("dropped").alias("line"))


_CELL_SQL = ", ".join(f"'{b} ' || a[1 + ({LEAD + 2 * b}) % len(a)] || ' ' || a[1 + ({LEAD + 1 + 5 * b} + len(a) // 2) % len(a)]" for b in range(1, BANDS + 1))
#: SQL for recurring lines of a relation ``docs`` (doc_id, text).
RECURRING_SQL = rf"""
l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS line FROM docs WHERE text IS NOT NULL),
k AS (SELECT doc_id, text, line, list_filter(string_split(translate(x, chr(9) || chr(11) || chr(12) || chr(13), '    '), ' '), lambda t: t <> '') AS w FROM l),
m AS (SELECT doc_id, text, line, list_transform(w, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '{FIELD}' ELSE t END) AS a FROM k WHERE len(w) > 0),
f AS (SELECT doc_id, text, line, a, array_to_string(a, ' ') AS masked, len(a) || ' ' || array_to_string(a[1:{LEAD}], ' ') AS leaf FROM m),
g AS (SELECT *, count(*) OVER (PARTITION BY leaf) AS n FROM f),
busy AS (SELECT doc_id, text, line, a, masked, leaf, unnest(['0', {_CELL_SQL}]) AS cell FROM g WHERE n >= {MIN_DOCS}),
c AS (SELECT leaf, cell, masked, any_value(a) AS a, count(*) AS n FROM busy GROUP BY leaf, cell, masked),
s AS (SELECT leaf, cell, arg_max(a, {{'n': n, 'masked': masked}}) AS seed FROM c GROUP BY leaf, cell),
b AS (SELECT doc_id, text, line, leaf, cell FROM busy JOIN s USING (leaf, cell) WHERE len(list_filter(range(1, len(a) + 1), lambda i: a[i] = seed[i])) >= {SIMILAR}::DOUBLE * len(a)),
r AS (SELECT leaf, cell, count(DISTINCT text) AS n FROM b GROUP BY leaf, cell),
gone AS (SELECT DISTINCT doc_id, line FROM b JOIN r USING (leaf, cell) WHERE r.n >= {MIN_DOCS} AND doc_id IS NOT NULL)"""

QUERIES = {"op5_line_dedup": op5_line_dedup}
SQL = {"op5_line_dedup": f"WITH docs AS (SELECT doc_id, text FROM documents),{RECURRING_SQL}\nSELECT doc_id, CAST(line AS INTEGER) AS line FROM gone"}
