"""Quality rules: a few heuristics, then a hashed n-gram log-likelihood ratio between trusted and raw text.

Everything is DataFrame functions. A document is kept if no heuristic fails and its mean log ratio per n-gram, of
the multinomial of the trusted documents to that of the whole corpus, is at least a threshold that held-out trusted
documents set.

N-grams are single words and pairs of neighbours, hashed into buckets whose number grows with the size of the corpus, at
every size: as its cube root, so the model, which reaches the tasks as a scalar subquery, is 2 MB for a GB of text and
95 MB for 100 TB. Counts cover every n-gram of every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvellum.llm.common import WORD, chained, table, words

#: Buckets are so many times the cube root of the number of characters; there is no upper bound.
BUCKETS_PER_ROOT = 256
SMOOTHING = 1.0
#: Trusted documents that are used at most: those with the smallest hashes of doc_id. Only this sample is bounded, so
#: that its ids can be broadcast; the raw model covers every document. One half gives the target model, the other half,
#: which the model hasn't seen, gives the threshold.
TRUSTED_LIMIT = 50_000
#: The threshold lies `MARGIN` times as far below the median of held-out scores as their `LOW_QUANTILE` does.
LOW_QUANTILE, MARGIN = 0.01, 1.5
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 10, 20, 5


def with_ngrams(docs: DataFrame) -> DataFrame:
    """``docs`` with __two__: hashes of neighbouring pairs of the word hashes __one__."""
    n = F.greatest(F.size("__one__") - 1, F.lit(0))
    return docs.withColumn("__two__", F.zip_with(F.slice("__one__", 1, n), F.slice("__one__", 2, n), lambda x, y: F.xxhash64(x, y)))


def hashed(w: Column) -> Column:
    """Hashes of an array of words."""
    return F.transform(w, lambda x: F.xxhash64(x))


def bucket(h: Column, buckets: int) -> Column:
    """Bucket of a hash."""
    return F.pmod(h, F.lit(buckets)).cast("int")


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, worked out once: a lambda that looks into an array must not hold the array's expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(hashes: Column) -> Column:
    """Words within five-word windows that the text has twice or more, the first included, from the words' hashes.

    Windows are compared by 64-bit hash. Most texts have no equal ones, which a hash set shows; in the others sorting
    brings equal ones together, and their places, in order, give the words they cover.
    """

    def runs(h: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
        return F.when(F.size(h) > WINDOW, each).otherwise(F.array().cast("array<bigint>"))

    def covered(p: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(p, i)["h"] == x["h"], F.lit(False))
        at = F.transform(p, lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x["i"]))
        return F.aggregate(
            F.sort_array(F.filter(at, lambda i: i.isNotNull())),
            F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
            lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last")),
            lambda s: s["n"],
        )

    def count(r: Column) -> Column:
        placed = F.sort_array(F.transform(r, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(r)) < F.size(r), _let(placed, covered)).otherwise(F.lit(0))

    return _let(_let(hashes, runs), count).cast("long")


def base_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the words' hashes in an array __one__ and the measures of the heuristics."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    a = docs.withColumn("__words__", words(F.col(f"`{text_col}`")))
    a = a.withColumn("__lines__", F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)))
    a = a.withColumn("n_words", F.size("__words__").cast("long"))
    a = a.withColumn("word_chars", F.aggregate("__words__", F.lit(0).cast("long"), lambda n, x: n + F.length(x)))
    a = a.withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"))
    a = a.withColumn("n_dup_lines", (F.size("__lines__") - F.size(F.array_distinct("__lines__"))).cast("long"))
    a = a.withColumn("__one__", hashed(F.col("__words__"))).drop("__lines__", "__words__").withColumn("n_repeat_words", repeated_words(F.col("__one__")))
    return a.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")))


def _scored(docs: DataFrame, model: DataFrame, buckets: int) -> DataFrame:
    """``docs``, which has __one__, with score: the mean log ratio of its n-grams, 0 without words."""
    a = with_ngrams(docs).withColumn("__ratio__", model.scalar())
    add = lambda s, h: s + F.get(F.col("__ratio__"), bucket(h, buckets))
    total = F.aggregate("__two__", F.aggregate("__one__", F.lit(0.0), add), add)
    n = F.size("__one__")
    return a.withColumn("score", F.when(n > 0, total / (2 * n - 1)).otherwise(F.lit(0.0))).drop("__one__", "__two__", "__ratio__")


def n_buckets(docs: DataFrame, text_col: str = "text") -> int:
    """Buckets for this corpus."""
    chars = docs.agg(F.sum(F.length(F.col(f"`{text_col}`")))).first()[0] or 0
    return max(1, round(BUCKETS_PER_ROOT * chars ** (1 / 3)))


def some_trusted(trusted: DataFrame) -> DataFrame:
    """(__id__, half) of the trusted documents that are used: half 1 for the model, half 0 for the threshold."""
    some = trusted.select(F.col("doc_id").alias("__id__")).where("__id__ IS NOT NULL").distinct().orderBy(F.xxhash64("__id__"), "__id__").limit(TRUSTED_LIMIT)
    return some.select("__id__", F.pmod(F.xxhash64("__id__", F.lit(1)), F.lit(2)).cast("int").alias("half"))


def log_ratios(docs: DataFrame, some: DataFrame, buckets: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, one array of ``buckets`` doubles: the log of trusted over raw probability of each bucket, in order.

    At most `TRUSTED_LIMIT` ids are broadcast, so texts are counted where they are read. Counts shrink to at most
    2 * ``buckets`` rows in a task before they are shuffled, so frequent n-grams make no skew, and buckets that no
    text has keep the ratio of no evidence. A document without an id counts as raw text only.
    """
    flag = F.broadcast(some.where("half = 1"))
    a = docs.select(F.col(f"`{id_col}`").alias("__doc__"), hashed(words(F.col(f"`{text_col}`"))).alias("__one__")).join(flag, F.col("__doc__") == F.col("__id__"), "left")
    a = with_ngrams(a).select(F.explode(F.concat("__one__", "__two__")).alias("h"), F.coalesce("half", F.lit(0)).alias("t"))
    a = a.select(bucket(F.col("h"), buckets).alias("b"), "t")
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"))
    counts = a.groupBy("b").agg(F.count("*").alias("raw"), F.sum("t").alias("target"))
    counts = every.join(counts, "b", "left").select("b", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    rows = counts.agg(F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target"), F.array_sort(F.collect_list(F.struct("b", "raw", "target"))).alias("all"))
    share = lambda n, total: (n + F.lit(SMOOTHING)) / (total + F.lit(SMOOTHING * buckets))
    return rows.select(F.transform("all", lambda x: F.log(share(x["target"], F.col("n_target"))) - F.log(share(x["raw"], F.col("n_raw")))).alias("ratio"))


def held_out_threshold(docs: DataFrame, some: DataFrame, model: DataFrame, buckets: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: the threshold that held-out trusted documents of `MIN_WORDS` words or more set; without any, below all scores."""
    held = F.broadcast(some.where("half = 0").select("__id__"))
    a = docs.select(F.col(f"`{id_col}`").alias("__doc__"), F.col(f"`{text_col}`").alias("x")).join(held, F.col("__doc__") == F.col("__id__"), "left_semi")
    a = a.select(hashed(words(F.col("x"))).alias("__one__")).where(F.size("__one__") >= MIN_WORDS)
    q = _scored(a, model, buckets).agg(F.expr(f"percentile(score, array({LOW_QUANTILE}D, 0.5D))").alias("q"))
    return q.select(F.coalesce(F.col("q")[1] - F.lit(MARGIN) * (F.col("q")[1] - F.col("q")[0]), F.lit(float("-inf"))).alias("threshold"))


def judge_quality(docs: DataFrame, trusted: DataFrame, threshold: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, threshold, kept.

    The model and, unless one is given, the threshold are worked out first, each one row behind a checkpoint. A null or
    empty text has no words: its base fails and its score is 0. Texts of any length are judged whole.
    Repeated rows are judged alike (and counted as often as they occur); with an empty ``trusted`` or an empty
    table nothing crashes, the ratio then only reflects smoothing and no score is below the threshold. Ties with the
    threshold are kept. Columns of the input that have the name of a new
    one give way to it. The score is a sum in text order over integer counts, so it is the same in every run.
    """
    spark = docs.sparkSession
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "threshold", "kept"]
    given = [c for c in docs.columns if c not in made]
    some, buckets = some_trusted(trusted), n_buckets(docs, text_col)
    model = chained(spark, log_ratios(docs, some, buckets, id_col, text_col))
    limit = F.lit(threshold) if threshold is not None else chained(spark, held_out_threshold(docs, some, model, buckets, id_col, text_col)).scalar()
    a = _scored(base_measures(docs.select(*[docs[f"`{c}`"] for c in given]), text_col), model, buckets).withColumn("threshold", limit)
    a = a.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.col("threshold")))
    return a.select(*[F.col(f"`{c}`") for c in given], *made)


def keep_good(docs: DataFrame, trusted: DataFrame, threshold: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that `judge_quality` rejects."""
    # The row number is there to keep the condition above the measures: pushed below, it would work them out twice.
    judged = judge_quality(docs, trusted, threshold, id_col, text_col).withColumn("__row__", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("__row__") >= 0)).select(*[F.col(f"`{c}`") for c in docs.columns])


def trusted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the labels call good."""
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document measured, scored and judged."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge_quality(docs, trusted_documents(spark, sf_dir)).drop("text")


QUERIES = {"op8_quality_rules": op8_quality_rules}
SQL: dict[str, str] = {}
