"""Near-duplicates by Order MinHash, verified by banded alignment.

A text is a row of words (cut at white space, A-Z lower-cased). Its k-mers of `K` words, each labelled with the number
of its occurrence, are ranked by `SKETCHES` hash functions; a sketch is the `KEEP` least k-mers of the whole text in the order in
which they stand there, so two sketches agree only if the texts share those k-mers in that order. Texts that agree in
a sketch are candidates; they are linked if their word edit distance is at most (1 - `SIMILAR`) of the longer one, found
by a bit-parallel alignment inside the band which that bound leaves.

Two texts whose k-mers agree to a Jaccard share J meet in a sketch with a probability of about J**KEEP. With a fifth of the
words replaced at random J is 0.2, and 64 sketches meet with 0.93; with 15 % J is 0.28 and they meet with 0.995. In texts of
few words one edit touches most k-mers, so those of up to `SHORT` words have `SHORT_SKETCHES` more sketches, of two-word k-mers.

Unlike texts that share a passage meet as well. What tells most of them apart before any text is fetched can't be true of
like ones: each candidate says where the shared k-mers stand, and what has to be put in or left out before, between and behind
them is a lower bound of the distance. So is half of the number of word classes, of `BITS`, of which one text has an odd number of words
and the other an even one, and of the difference of their lengths. Texts that share a bucket with a large class are compared with its members block by block, so that a text moves once for a block of others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvellum.llm.common import chained, mix, row_slices, short_batches, string_bytes, table, word_hashes
from corvellum.llm.components import components

K, KEEP, SKETCHES, SIMILAR = 5, 2, 64, 0.8
SHORT, SHORT_K, SHORT_SKETCHES = 50, 2, 32
BITS = 2048
#: Members from which on a class is large, and texts of a block of it.
LARGE, BLOCK = 64, 64
#: Rounds in which each text is compared with one centre of its buckets, before all that is left is compared.
ROUNDS = 4
#: Words that a text has more often than this get a bit vector in the alignment, the others a list of places.
FREQUENT = 32
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def sketches(h: np.ndarray, at: np.ndarray, k: int = K, number: int = SKETCHES) -> tuple[np.ndarray, np.ndarray]:
    """Order MinHash of rows of words: (rows, number) 64-bit keys, and where the first and last of their k-mers begin, as
    first << 32 | last. Rows without words have zeros."""
    words = np.diff(at)
    rows = np.flatnonzero(words > 0)
    keys, places = np.zeros((len(words), number), np.uint64), np.zeros((len(words), number), np.int64)
    if not len(rows):
        return keys, places
    # k-mers that begin at each word; a shorter text has one k-mer of all its words
    counts = np.maximum(words[rows] - k + 1, 1)
    starts = np.cumsum(counts) - counts
    row = np.repeat(np.arange(len(rows)), counts)
    within = np.arange(len(row)) - starts[row]
    place = within + at[rows][row]
    size = np.minimum(words[rows], k)[row]
    kmer = np.zeros(len(row), np.uint64)
    for j in range(k):
        kmer = np.where(j < size, kmer * _A + h[np.minimum(place + j, len(h) - 1)], kmer)
    kmer = mix(kmer + np.uint64(k))
    # occurrence labels: equal k-mers of a row come together in a stable sort
    apart = mix(kmer ^ (row.astype(np.uint64) * _B))
    order = np.argsort(apart, kind="stable")
    new = np.append(True, apart[order][1:] != apart[order][:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    label = np.empty(len(order), np.uint64)
    label[order] = (np.arange(len(order)) - first).astype(np.uint64)
    kmer = mix(kmer + label * _B)
    # rank and number of a k-mer in one integer, so that a minimum tells both
    numbers, low = np.arange(len(kmer), dtype=np.uint64), np.uint64(0xFFFFFFFF)
    most = np.minimum(counts, KEEP)
    for s in range(number):
        rank = kmer * (mix(np.array([s + 1], np.uint64) * _A)[0] | np.uint64(1))
        rank ^= rank >> np.uint64(29)
        rank &= ~low
        rank |= numbers
        found = np.zeros((KEEP, len(rows)), np.int64)
        for t in range(KEEP):
            found[t] = np.minimum.reduceat(rank, starts) & low
            rank[found[t][t < most]] = np.uint64(2**64 - 1)
        found = np.where(np.arange(KEEP)[:, None] < most, found, found[0])
        found.sort(axis=0)
        key = np.full(len(rows), np.uint64(s + 1)) * _B + np.uint64(k)
        for t in range(KEEP):
            key = mix(key * _A + kmer[found[t]])
        keys[rows, s] = key
        places[rows, s] = (within[found[0]] << 32) | within[found[-1]]
    return keys, places


def odd_classes(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows, BITS / 64) words of 64 bits: of which classes a row has an odd number of words. Taking a word away or putting one in changes one bit."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    found, times = np.unique(row * BITS + (h >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64), return_counts=True)
    found = found[times % 2 == 1]
    out = np.zeros((len(at) - 1) * BITS // 64, np.uint64)
    np.add.at(out, found >> 6, np.uint64(1) << (found & 63).astype(np.uint64))
    return out.reshape(-1, BITS // 64)


def banded_distance(a: list[int], b: list[int], most: int) -> int:
    """Edit distance of two rows of words if at most ``most``, else ``most`` + 1, looking only at the band that can hold it.

    Columns are runs of 2 * most + 2 bits that slide down one row at each word of ``b``. Where a word of ``b`` stands in
    ``a`` is a list of places, cut to the band, or for a frequent word a bit vector that is shifted to it.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    if most >= len(a):
        most = len(a)
    if not b:
        return len(a)
    width = 2 * most + 2
    ones = (1 << width) - 1
    places: dict[int, list[int]] = {}
    for i, w in enumerate(a):
        places.setdefault(w, []).append(i)
    often: dict[int, int] = {}
    for w, at in places.items():
        if len(at) > FREQUENT:
            bits = bytearray(at[-1] // 8 + 1)
            for i in at:
                bits[i >> 3] |= 1 << (i & 7)
            often[w] = int.from_bytes(bits, "little")
    vp, vn, score = ones & ~((1 << (width - 1 - most)) - 1), 0, most
    low = 1 << (width - 1)
    side = 1 << (width - 2)
    stop = most + len(b) - (len(a) - most)
    shift = most - width + 1
    for j, w in enumerate(b):
        x = often.get(w)
        if x is not None:
            x = (x >> shift if shift >= 0 else x << -shift) & ones
        else:
            x = 0
            for i in places.get(w, ()):
                if 0 <= i - shift < width:
                    x |= 1 << (i - shift)
        shift += 1
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & ones
        hp = (vn | ~(d0 | vp)) & ones
        hn = d0 & vp
        if j < len(a) - most:
            score += not d0 & low
        else:
            score += bool(hp & side) - bool(hn & side)
            side >>= 1
        if score > stop:
            return most + 1
        d0 >>= 1
        vp = (hn | ~(d0 | hp)) & ones
        vn = d0 & hp
    return score if score <= most else most + 1


def alike(x: np.ndarray, y: np.ndarray, similar: float) -> bool:
    """Whether two rows of words are within the distance that ``similar`` leaves; what they have in common at both ends
    has no part in it and is cut off first."""
    most = int((1 - similar) * max(len(x), len(y)) + 1e-9)
    m = min(len(x), len(y))
    if max(len(x), len(y)) - m > most:
        return False
    apart = np.flatnonzero(x[:m] != y[:m])
    begin = int(apart[0]) if len(apart) else m
    apart = np.flatnonzero(x[len(x) - m + begin :] != y[len(y) - m + begin :])
    end = m - begin - 1 - int(apart[-1]) if len(apart) else m - begin
    return banded_distance(x[begin : len(x) - end].tolist(), y[begin : len(y) - end].tolist(), most) <= most


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tid, text), tid being a 64-bit digest of the text; a null text is empty."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("tid"), text.alias("text"))


def _sketched(named: DataFrame) -> DataFrame:
    """(doc_id, tid, n, bits, keys, places): number of words, classes of words, sketches and where their k-mers stand."""

    def run(batches):
        for batch in batches:
            raw, off = string_bytes(batch.column(2))
            for a, b in row_slices(off):
                h, at = word_hashes(raw[off[a] : off[b]], off[a : b + 1] - off[a])
                n = np.diff(at)
                keys, places = sketches(h, at)
                size = np.full(b - a, SKETCHES)
                short = (n > 0) & (n <= SHORT)
                if short.any():  # their words laid end to end
                    mine = np.repeat(short, n)
                    more, more_places = sketches(h[mine], np.append(0, np.cumsum(n[short])), SHORT_K, SHORT_SKETCHES)
                    size[short] += SHORT_SKETCHES
                    room = np.repeat(short, size)
                    room[np.flatnonzero(room)[(np.arange(room.sum()) % (SKETCHES + SHORT_SKETCHES)) < SKETCHES]] = False
                    keys, places = (np.zeros(size.sum(), x.dtype) for x in (keys, places)), (keys, places, more, more_places)
                    keys, places = _laid(room, *keys, *places)
                ends = np.append(0, np.cumsum(size)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.reshape(-1).view(np.int64))) for x in (keys, places)]
                bits = pa.ListArray.from_arrays(np.arange(0, (b - a) * BITS // 64 + 1, BITS // 64, dtype=np.int32), pa.array(odd_classes(h, at).reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(n, pa.int64()), bits, *lists], names=["doc_id", "tid", "n", "bits", "keys", "places"])

    return short_batches(named).where("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, tid long, n long, bits array<long>, keys array<long>, places array<long>")


def _laid(room: np.ndarray, keys: np.ndarray, places: np.ndarray, a: np.ndarray, b: np.ndarray, more_a: np.ndarray, more_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of sketches laid end to end, those of short texts with their further ones behind, which go where ``room`` says."""
    for out, x, more in ((keys, a, more_a), (places, b, more_b)):
        out[~room], out[room] = x.reshape(-1), more.reshape(-1)
    return keys, places


def _word_rows(named: DataFrame) -> DataFrame:
    """(tid, w): the words of each text as packed 32-bit hashes."""

    def run(batches):
        for batch in batches:
            raw, off = string_bytes(batch.column(1))
            packed = []
            for a, b in row_slices(off):
                h, at = word_hashes(raw[off[a] : off[b]], off[a : b + 1] - off[a])
                h = (h >> np.uint64(32)).astype("<u4")
                packed += [h[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["tid", "w"])

    return short_batches(named).select("tid", "text").mapInArrow(run, "tid long, w binary")


def _verified(pairs: DataFrame, rows: DataFrame, similar: float) -> DataFrame:
    """The rows of ``pairs`` (text_a, text_b and more, all long) whose texts are alike. Each pair carries its two texts here and no
    further; a text that is in very many pairs is one row that a skewed join meets in parts."""
    kept = pairs.columns

    def run(batches):
        for batch in batches:
            ok = [alike(*(np.frombuffer(v.as_buffer(), "<u4") for v in both), similar) for both in zip(batch.column(len(kept)), batch.column(len(kept) + 1), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:-2], names=kept).filter(pa.array(ok, pa.bool_()))

    full = pairs.join(rows.select(F.col("tid").alias("text_a"), F.col("w").alias("wa")), "text_a").join(rows.select(F.col("tid").alias("text_b"), F.col("w").alias("wb")), "text_b")
    return short_batches(full).select(*kept, "wa", "wb").mapInArrow(run, ", ".join(f"{c} long" for c in kept))


def _most(similar: float, n: str = "n", m: str = "m") -> Column:
    return F.greatest(n, m) * F.lit(1 - similar) + 1e-9


def _placed(similar: float) -> Column:
    """Whether texts of n and m words that share two k-mers at ``p`` and ``q`` can be alike: words that have to be put in
    or left out before, between and behind them."""
    i, j, x, y = F.shiftright("p", 32), F.col("p").bitwiseAND(0x7FFFFFFF), F.shiftright("q", 32), F.col("q").bitwiseAND(0x7FFFFFFF)
    return F.abs(i - x) + F.abs((j - i) - (y - x)) + F.abs((F.col("n") - j) - (F.col("m") - y)) <= _most(similar)


def _counted(similar: float) -> Column:
    """Whether texts with those odd classes can be alike: an edit changes two bits at most, and one where it changes the length."""
    apart = F.lit(0)
    for i in range(BITS // 64):
        apart += F.bit_count(F.get("bits", F.lit(i)).bitwiseXOR(F.get("bits_b", F.lit(i))))
    return apart + F.abs(F.col("n") - F.col("m")) <= 2 * _most(similar)


def _rank(c: str, seed: int) -> Column:
    return F.xxhash64(c, F.lit(seed))


def _entries(members: DataFrame, *more: str) -> DataFrame:
    """A row for each sketch of a text that another text has: key and place p."""
    return members.select("tid", "n", "label", *more, F.explode("at").alias("e")).select("tid", "n", "label", *more, "e.key", F.col("e.place").alias("p"))


def _candidates(members: DataFrame, seed: int, similar: float) -> DataFrame:
    """At most one pair for each text: itself (text_a) with the centre (text_b) of most of its buckets.

    A bucket's centre is its text of the least hash, so a group of texts that share many buckets has few centres; and the centre
    of a text's near copies is that of more of its buckets than the centre of unlike texts which share a passage with it.
    """
    e = _entries(members)
    first = F.min(F.struct(_rank("tid", seed).alias("r"), F.col("tid").alias("b"), F.col("n").alias("m"), F.col("label").alias("lb"), F.col("p").alias("q")))
    mixed = e.groupBy("key").agg(first.alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key", "c.*")
    met = e.join(mixed, "key").where((F.col("label") != F.col("lb")) & _placed(similar))
    each = met.groupBy("tid", "b", "r", "lb", "label").count()
    best = each.groupBy(F.col("tid").alias("text_a")).agg(F.max(F.struct("count", "r", "b", "lb", "label")).alias("c"))
    return best.select("text_a", F.col("c.b").alias("text_b"), F.col("c.label").alias("la"), F.col("c.lb").alias("lb"))


def _relabelled(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members after the links ``found`` (la, lb): a link takes the class that ranks later into the other."""
    to = found.groupBy(F.greatest("la", "lb").alias("label")).agg(F.min(F.least("la", "lb")).alias("to"))
    for _ in range(2):
        far = to.select(F.col("label").alias("to"), F.col("to").alias("far"))
        to = to.join(far, "to", "left").select("label", F.coalesce("far", "to").alias("to"))
    return members.join(to, "label", "left").select("tid", "n", "bits", "at", F.coalesce("to", "label").alias("label"))


def _any_alike(similar: float):
    """Of a block of texts (side 0) and members of a class (side 1): the first member that each text is like."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        words = [np.frombuffer(w, "<u4") for w in f["w"]]
        sizes = np.array([len(w) for w in words])
        counts = np.stack([np.bincount(w & 2047, minlength=2048) for w in words])
        inside, out = np.flatnonzero(f["side"].to_numpy() == 1), []
        for i in np.flatnonzero(f["side"].to_numpy() == 0):
            more = counts[i] - counts[inside]
            most = (1 - similar) * np.maximum(sizes[i], sizes[inside]) + 1e-9
            can = (np.maximum(more, 0).sum(1) <= most) & (np.maximum(-more, 0).sum(1) <= most)
            for j in inside[can]:
                if alike(words[i], words[j], similar):
                    out.append((f["tid"].iloc[i], f["tid"].iloc[j], f["own"].iloc[i], f["label"].iloc[j]))
                    break
        return pd.DataFrame(out, columns=["text_a", "text_b", "la", "lb"])

    return run


def _against_large(members: DataFrame, rows: DataFrame, similar: float) -> DataFrame:
    """Links of texts to large classes with which they share a bucket: each with all members, in blocks of about `BLOCK` on both sides."""
    large = members.groupBy("label").agg(F.count("*").alias("size")).where(F.col("size") >= LARGE)
    entries = _entries(members)
    keys = entries.join(large, "label").select("key", F.col("label").alias("large")).distinct()
    # of two large classes, members of the one that ranks later are compared with the other
    outside = entries.join(keys, "key").join(large.select("label", F.lit(True).alias("is_large")), "label", "left")
    outside = chained(members.sparkSession, outside.where((F.col("label") != F.col("large")) & (F.col("is_large").isNull() | (F.col("label") > F.col("large")))).select("tid", "label", "large").distinct())
    pieces = outside.groupBy("large").agg(F.ceil(F.count("*") / BLOCK).alias("n_out")).join(large.select(F.col("label").alias("large"), F.ceil(F.col("size") / BLOCK).alias("n_in")), "large")
    part = lambda n: F.pmod(F.xxhash64("tid"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    a = outside.join(pieces, "large").select("tid", F.col("label").alias("own"), F.col("large").alias("label"), F.lit(0).alias("side"), part("n_out").alias("i"), every("n_in").alias("j"))
    b = members.select("tid", "label").join(pieces.withColumnRenamed("large", "label"), "label").select("tid", F.lit(0).cast("long").alias("own"), "label", F.lit(1).alias("side"), every("n_out").alias("i"), part("n_in").alias("j"))
    met = a.unionByName(b).join(rows, "tid")
    return met.groupBy("label", "i", "j").applyInPandas(_any_alike(similar), "text_a long, text_b long, la long, lb long")


def _all_left(members: DataFrame, similar: float) -> DataFrame:
    """All pairs that share a bucket, are of different classes, none of them large, and can be alike, each once.

    In a bucket the texts outside its largest class are paired with all others, so a large class that is already known
    isn't paired with itself. Of the buckets that a pair shares it is made in the one with the least key. (Keys are compared on 32
    bits here: of a million pairs that share one, one is expected to be taken for sharing another and to be left out.)
    """
    large = members.groupBy("label").agg(F.count("*").alias("size")).where(F.col("size") >= LARGE)
    short = F.transform("at", lambda e: F.shiftright(e["key"], 32).cast("int"))
    e = members.join(large.select("label"), "label", "left_anti").withColumn("short", short)
    e = _entries(e, "bits", "short")
    sizes = e.groupBy("key", "label").agg(F.count("*").alias("size")).groupBy("key").agg(F.max(F.struct("size", "label"))["label"].alias("major"), F.count("*").alias("classes"))
    e = e.join(sizes.where("classes > 1").select("key", "major"), "key")
    one = e.where("label <> major")
    two = e.select("key", *[F.col(c).alias(d) for c, d in (("tid", "b"), ("n", "m"), ("label", "lb"), ("p", "q"), ("bits", "bits_b"), ("short", "short_b"))])
    once = (F.col("lb") == F.col("major")) | (F.col("tid") < F.col("b"))
    least = F.array_min(F.array_intersect("short", "short_b")) == F.shiftright("key", 32).cast("int")
    met = one.join(two, "key").where((F.col("label") != F.col("lb")) & once & _placed(similar) & _counted(similar) & least)
    return met.select(F.col("tid").alias("text_a"), F.col("b").alias("text_b"), F.col("label").alias("la"), "lb")


def _links(named: DataFrame, stands: DataFrame, similar: float) -> DataFrame:
    """(a, b): digests of texts that are linked; as many links as it takes to connect each class.

    In each of `ROUNDS` rounds every text is compared with one centre of its buckets, which puts most of a large group
    into one class. Then texts are compared with all members of large classes that they share a bucket with, and every pair
    of a bucket that is still in different classes and can be alike is compared, so no two texts that share a sketch end apart
    without having been compared. That is quadratic only in texts of a bucket that are unlike its largest class.
    """
    spark = named.sparkSession
    entry = stands.where("n > 0").select("tid", F.explode(F.arrays_zip(F.col("keys").alias("key"), F.col("places").alias("place"))).alias("e"))
    busy = entry.groupBy("e.key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    shared = entry.select("tid", "e", F.col("e.key").alias("key")).join(busy, "key", "left_semi").groupBy("tid").agg(F.collect_list("e").alias("at"))
    members = chained(spark, shared.join(stands.select("tid", "n", "bits"), "tid").withColumn("label", _rank("tid", 0)))
    texts = named.join(members.select("tid"), "tid", "left_semi")
    rows = chained(spark, _word_rows(texts.groupBy("tid").agg(F.first("text").alias("text"))))
    links = None
    for seed in range(ROUNDS):
        found = chained(spark, _verified(_candidates(members, seed, similar), rows, similar))
        links = found if links is None else links.union(found)
        members = chained(spark, _relabelled(members, found))
    found = chained(spark, _against_large(members, rows, similar))
    links = links.select("text_a", "text_b").union(found.select("text_a", "text_b"))
    members = chained(spark, _relabelled(members, found))
    rest = _verified(_all_left(members, similar), rows, similar)
    # one link connects two classes as well as all of them do
    rest = chained(spark, rest.groupBy(F.least("la", "lb").alias("la"), F.greatest("la", "lb").alias("lb")).agg(F.min(F.struct("text_a", "text_b")).alias("x")))
    return links.select("text_a", "text_b").union(rest.select("x.*")).toDF("a", "b")


def _classes(named: DataFrame, similar: float) -> DataFrame:
    """(doc_id, tid, class_id) of every row that has an id."""
    spark = named.sparkSession
    all_rows = chained(spark, _sketched(named))
    one = F.struct("n", "bits", "keys", "places")
    stands = all_rows.groupBy("tid").agg(F.first(one).alias("x")).select("tid", "x.*")
    label = components(_links(named, stands, similar))
    labelled = all_rows.select("doc_id", "tid").join(label.withColumnRenamed("id", "tid"), "tid", "left").withColumn("label", F.coalesce("label", "tid"))
    least = labelled.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    return labelled.join(least, "label").select("doc_id", "tid", "class_id")


def near_duplicate_classes(docs: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id) of every document that has an id; the class is known by its least doc_id.

    Equal texts are put together first, by 64-bit digest. Each different text then stands for its copies; pairs
    that share a sketch are compared as `_links` says, and classes are the connected components of the links.

    Null and empty texts have no sketch: they are copies of each other. Texts of under `K` words have one short k-mer.
    Texts of any length are compared whole. Rows that repeat a doc_id give one row, with the least class of its texts. Rows with a null
    doc_id are left out, as nothing could refer to them. Other columns are ignored, whatever their names; an empty
    table gives no rows.
    """
    return _classes(_named(docs, id_col, text_col), similar).groupBy("doc_id").agg(F.min("class_id").alias("class_id"))


def keep_one_of_each(docs: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class, the one with the least doc_id; rows with a null doc_id stay. Rows that repeat
    a doc_id are judged each by its own text. Columns of any name pass through."""
    gone = _classes(_named(docs, id_col, text_col), similar).where("doc_id <> class_id").select("doc_id", "tid").distinct()
    own = F.xxhash64(F.coalesce(docs[f"`{text_col}`"], F.lit("")))
    return docs.join(gone, (docs[f"`{id_col}`"].cast("long") == gone["doc_id"]) & (own == gone["tid"]), "left_anti")


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class."""
    return near_duplicate_classes(table(spark, sf_dir, "documents"))


QUERIES = {"op7_order_minhash": op7_order_minhash}
SQL: dict[str, str] = {}
