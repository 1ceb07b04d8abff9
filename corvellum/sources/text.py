"""Matrix, sample sheet, gene set and panel files as long DataFrames. Every reader stays distributed: lines are numbered
by file position, headers are joined by position, and malformed rows are counted, not swallowed."""

from __future__ import annotations

import hashlib
import json
import os
import urllib.request
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(n, line) of a text file, gzip or plain, latin-1; n grows with the position in the file."""
    df = spark.read.option("encoding", "ISO-8859-1").option("lineSep", "\n").text(path)
    return df.select(F.monotonically_increasing_id().alias("n"), F.regexp_replace("value", "\r$", "").alias("line"))


def _head(lines: DataFrame, k: int) -> list[str]:
    return [r.line for r in lines.orderBy("n").limit(k).collect()]


def wide_matrix(spark: SparkSession, path: str, sep: str = "\t", label_row: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """A text matrix of features in rows and units in columns: (expr, units with label, number of malformed rows).

    The header names the units after a blank or named first field; a label row may follow; one empty trailing field is
    let pass. A row is malformed if its number of fields or one of its values isn't right.
    """
    lines = lines_of(spark, path)
    head = _head(lines, 2)
    names = head[0].split(sep)
    body = head[1].split(sep)
    names = names[1:] if len(names) == len(body) or names[0] == "" or names[-1] == "" and len(names) == len(body) else names
    names = names[:-1] if names and names[-1] == "" else names
    labels = body[1 : len(names) + 1] if label_row else [None] * len(names)
    units = spark.createDataFrame(list(zip(range(len(names)), names, labels, strict=True)), "pos int, unit_id string, label string")
    skip = 2 if label_row else 1
    first = [r.n for r in lines.orderBy("n").limit(skip).collect()]
    parts = lines.where(~F.col("n").isin(first)).where("line <> ''").select(F.split("line", sep).alias("f"))
    values = F.slice("f", 2, len(names))
    right = (F.size("f") == len(names) + 1) | ((F.size("f") == len(names) + 2) & (F.element_at("f", -1) == ""))
    numbers = F.forall(values, lambda v: v.try_cast("double").isNotNull())
    bad = parts.where(~(right & numbers)).count()
    cells = parts.where(right & numbers).select(F.trim(F.get("f", F.lit(0))).alias("feature_id"), F.posexplode(F.transform(values, lambda v: v.cast("double"))).alias("pos", "value"))
    expr = cells.where("value <> 0").join(F.broadcast(units), "pos").select("unit_id", "feature_id", "value")
    return expr, units.select("unit_id", "label"), bad


def cells_csv(spark: SparkSession, paths: Sequence[str], id_column: str, label_column: str) -> tuple[DataFrame, DataFrame]:
    """A table of units in rows: (expr, units with label); all other columns are features."""
    df = spark.read.option("header", True).csv(list(paths))
    features = [c for c in df.columns if c not in (id_column, label_column)]
    long = df.select(F.col(id_column).alias("unit_id"), F.explode(F.map_from_arrays(F.array(*map(F.lit, features)), F.array(*[F.col(f"`{c}`").cast("double") for c in features]))).alias("feature_id", "value"))
    return long.where("value <> 0"), df.select(F.col(id_column).alias("unit_id"), F.col(label_column).alias("label"))


def sample_sheet(spark: SparkSession, path: str, header_starts: str, rows_start: str, wanted: dict[str, str], sep: str = "\t") -> DataFrame:
    """Rows of a commented sheet: comments end at the header line; columns are chosen by a substring of their name."""
    lines = lines_of(spark, path)
    header = next(h for h in _head(lines.where(F.col("line").startswith(header_starts)), 1)).split(sep)
    at = {new: next(i for i, h in enumerate(header) if part.lower() in h.lower()) for new, part in wanted.items()}
    rows = lines.where(F.col("line").startswith(rows_start) & ~F.col("line").startswith(header_starts)).select(F.split("line", sep).alias("f"))
    return rows.select(*[F.trim(F.get("f", F.lit(i))).alias(new) for new, i in at.items()])


def matrix_market(spark: SparkSession, path: str, features: Sequence[str], units: Sequence[str]) -> DataFrame:
    """Stored entries of a features-by-units MatrixMarket file as long rows; the sizes it names are checked."""
    lines = lines_of(spark, path).where(~F.col("line").startswith("%") & (F.trim("line") != ""))
    size = [int(x) for x in _head(lines, 1)[0].split()[:2]]
    if size != [len(features), len(units)]:
        raise ValueError(f"the matrix is {size[0]} x {size[1]}, the names are {len(features)} x {len(units)}")
    first = lines.orderBy("n").limit(1).collect()[0].n
    f = F.split(F.trim("line"), r"\s+")
    cells = lines.where(F.col("n") != first).select(f[0].cast("int").alias("i"), f[1].cast("int").alias("j"), f[2].cast("double").alias("value"))
    spark_names = lambda xs, k, name: spark.createDataFrame(list(enumerate(xs, 1)), f"{k} int, {name} string")
    return cells.join(F.broadcast(spark_names(features, "i", "feature_id")), "i").join(F.broadcast(spark_names(units, "j", "unit_id")), "j").select("unit_id", "feature_id", "value")


def gene_sets(spark: SparkSession, path: str) -> DataFrame:
    """(term, feature_id) of a GMT file: upper case, each once; comment and short lines are left out."""
    f = lines_of(spark, path).where(~F.col("line").startswith("#")).select(F.split("line", "\t").alias("f")).where(F.size("f") >= 3)
    rows = f.select(F.get("f", F.lit(0)).alias("term"), F.explode(F.slice("f", 3, F.greatest(F.size("f") - 2, F.lit(0)))).alias("g"))
    return rows.select("term", F.upper(F.trim("g")).alias("feature_id")).where("feature_id <> ''").distinct()


def listed(text: Column) -> Column:
    """Entries of a list kept in one string with ';' or ',' between."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[;,]"), lambda x: F.trim(x)), lambda x: x != "")


def marker_panel(panel: DataFrame) -> DataFrame:
    """(cell_type, gene, sign, source) of a panel with cell_type, positive and, if given, negative and source."""
    for c in ("cell_type", "positive"):
        if c not in panel.columns:
            raise ValueError(f"the panel has no column {c}")
    optional = lambda c: F.col(c) if c in panel.columns else F.lit(None).cast("string")
    p = panel.select("cell_type", "positive", optional("negative").alias("negative"), optional("source").alias("source"))
    signed = F.concat(F.transform(listed(F.col("positive")), lambda g: F.struct(g.alias("gene"), F.lit("+").alias("sign"))), F.transform(listed(F.col("negative")), lambda g: F.struct(g.alias("gene"), F.lit("-").alias("sign"))))
    return p.select("cell_type", F.explode(signed).alias("g"), "source").select("cell_type", "g.gene", "g.sign", "source")


def panel_from_guide(guide: DataFrame, organism: str, per_type: int = 8, sharing: int = 2) -> DataFrame:
    """A panel from marker rows (cell_type, symbol, organism, canonical boolean, score): canonical ones first, then by
    score; mitochondrial and ribosomal symbols and those of too many types are dropped."""
    from pyspark.sql import Window

    g = guide.where(F.col("canonical") | (F.col("organism") == organism)).withColumn("symbol", F.upper("symbol"))
    g = g.where(~F.col("symbol").rlike("^(MT-|RPL|RPS|MRPL|MRPS)"))
    once = Window.partitionBy("cell_type", "symbol").orderBy(F.col("canonical").desc(), F.col("score").desc_nulls_last())
    g = g.withColumn("i", F.row_number().over(once)).where("i = 1")
    few = g.groupBy("symbol").agg(F.countDistinct("cell_type").alias("k")).where(F.col("k") <= sharing).select("symbol")
    order = Window.partitionBy("cell_type").orderBy(F.col("canonical").desc(), F.col("score").desc_nulls_last(), "symbol")
    top = g.join(few, "symbol", "left_semi").withColumn("i", F.row_number().over(order)).where(F.col("i") <= per_type)
    return top.groupBy("cell_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "symbol"))), lambda x: x["symbol"]), ";").alias("positive"))


def pathway_sets(pathways: DataFrame, links: DataFrame, genes: DataFrame) -> DataFrame:
    """(term, feature_id) from three listings: pathway (id, name), link (pathway_id, gene_id), gene (gene_id, symbol)."""
    return links.join(pathways, links["pathway_id"] == pathways["id"]).join(genes, "gene_id").select(F.col("name").alias("term"), F.upper("symbol").alias("feature_id")).distinct()


def caveats(spark: SparkSession, path: str, exclude: str) -> DataFrame:
    """WARN and FAIL checks and checks not run, of all JSON reports but one stage's own."""
    r = spark.read.option("multiLine", True).schema("checks array<struct<check:string,status:string,detail:string>>, not_run array<string>").json(path)
    r = r.withColumn("stage", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)).where(F.col("stage") != exclude)
    bad = r.select("stage", F.explode("checks").alias("c")).where("c.status IN ('WARN', 'FAIL')").select("stage", "c.check", "c.status", "c.detail")
    return bad.unionByName(r.select("stage", F.explode("not_run").alias("check"), F.lit("NOT RUN").alias("status"), F.lit(None).cast("string").alias("detail")))


def file_integrity(spark: SparkSession, path: str, expected: DataFrame | None = None) -> DataFrame:
    """Size and SHA-256 of each file; with ``expected`` (name, bytes, sha256; null where not known) also what became of
    the comparison: PASS, FAIL, or INFO where there is nothing to compare with."""
    seen = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    if expected is None:
        return seen
    e = expected.select(F.col("name").alias("__name__"), F.col("bytes").alias("__bytes__"), F.lower("sha256").alias("__sha256__"))
    j = seen.join(e, F.element_at(F.split("path", "/"), -1) == F.col("__name__"), "full")
    said = lambda got, want: F.when(F.col("path").isNull(), "FAIL").when(F.col(want).isNull(), "INFO").when(F.col(got) == F.col(want), "PASS").otherwise("FAIL")
    return j.select(F.coalesce("path", "__name__").alias("path"), "bytes", "sha256", said("bytes", "__bytes__").alias("size_status"), said("sha256", "__sha256__").alias("hash_status"))


def expectations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A table of expectations as (rules, wanted): rules are (expectation, kind, col, grp, against, direction, min_fraction,
    low, high), wanted has a row for each feature, or set, that an expectation names. Columns that the file lacks are null."""
    raw = spark.read.option("header", True).csv(path)
    for c in ("expectation", "kind", "column", "group"):
        if c not in raw.columns:
            raise ValueError(f"the table of expectations has no column {c}")
    raw = raw.where("expectation IS NOT NULL")
    given = lambda c, kind: F.trim(F.col(f"`{c}`")).try_cast(kind) if c in raw.columns else F.lit(None).cast(kind)
    rules = raw.select(given("expectation", "string").alias("expectation"), given("kind", "string").alias("kind"), given("column", "string").alias("col"), given("group", "string").alias("grp"), F.coalesce(given("against", "string"), F.lit("")).alias("against"), F.coalesce(F.nullif(given("direction", "string"), F.lit("")), F.lit("up")).alias("direction"), *[given(c, "double").alias(c) for c in ("min_fraction", "low", "high")])
    named = F.concat(listed(given("genes", "string")), F.filter(F.array(given("set", "string")), lambda x: F.coalesce(x != "", F.lit(False))))
    return rules, raw.select(given("expectation", "string").alias("expectation"), F.explode(named).alias("feature_id"))


def labelled_reference(spark: SparkSession, expr_path: str, labels_path: str, label_column: str, id_column: str = "unit_id") -> DataFrame:
    """(unit_id, label, feature_id, value) of a reference kept as Parquet (unit_id, feature_id, value) with labels in CSV or
    Parquet; units without a label are left out, a missing label column is refused."""
    labels = spark.read.parquet(labels_path) if labels_path.rstrip("/").endswith(".parquet") else spark.read.option("header", True).csv(labels_path)
    missing = [c for c in (label_column, id_column) if c not in labels.columns]
    if missing:
        raise ValueError(f"the labels have no column {missing[0]}")
    named = labels.select(F.col(f"`{id_column}`").cast("string").alias("unit_id"), F.col(f"`{label_column}`").cast("string").alias("label")).where("label <> ''").dropDuplicates(["unit_id"])
    expr = spark.read.parquet(expr_path).select(F.col("unit_id").cast("string").alias("unit_id"), "feature_id", F.col("value").cast("double").alias("value"))
    return expr.join(named, "unit_id").select("unit_id", "label", "feature_id", "value")


def guide_rows(spark: SparkSession, path: str) -> DataFrame:
    """Marker rows for `panel_from_guide` from JSON of the form {type: {id, canonical: [symbol], computational: [{symbol,
    organism, marker_score}]}}, one object or one line each."""
    computed = "struct<symbol:string,organism:string,marker_score:double>"
    raw = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", f"map<string,struct<id:string,canonical:array<string>,computational:array<{computed}>>>")).alias("cell_type", "x"))
    canonical = raw.select("cell_type", F.explode("x.canonical").alias("symbol"), F.lit(None).cast("string").alias("organism"), F.lit(True).alias("canonical"), F.lit(None).cast("double").alias("score"))
    other = raw.select("cell_type", F.explode("x.computational").alias("m")).select("cell_type", "m.symbol", "m.organism", F.lit(False).alias("canonical"), F.col("m.marker_score").alias("score"))
    return canonical.unionByName(other)


def gzip_reads(path: str) -> bool:
    """Whether a gzip file decompresses to its end."""
    import gzip

    try:
        with gzip.open(path) as f:
            while f.read(1 << 20):
                pass
    except (OSError, EOFError):
        return False
    return True


def file_hash(path: str) -> str:
    """SHA-256 of one file, read in pieces."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while piece := f.read(1 << 20):
            h.update(piece)
    return h.hexdigest()


def parameter_hash(params: dict) -> str:
    """Sixteen hexadecimal digits that change with any parameter."""
    return hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:16]


def fetch(urls: Sequence[str], target: str, timeout: float = 60.0) -> list[dict]:
    """Bring a file here unless it is; addresses are tried in order, and each outcome is a row."""
    if os.path.exists(target):
        return [{"url": None, "status": "present", "bytes": os.path.getsize(target), "sha256": file_hash(target)}]
    rows = []
    for url in urls:
        try:
            with urllib.request.urlopen(url, timeout=timeout) as r, open(f"{target}.part", "wb") as f:
                while piece := r.read(1 << 20):
                    f.write(piece)
            os.replace(f"{target}.part", target)
            rows.append({"url": url, "status": "retrieved", "bytes": os.path.getsize(target), "sha256": file_hash(target)})
            break
        except (OSError, ValueError) as e:
            rows.append({"url": url, "status": f"failed: {e}", "bytes": None, "sha256": None})
    return rows
