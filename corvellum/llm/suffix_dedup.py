"""Suffix-array dedup: bytes within a run of `LENGTH` bytes that also starts earlier are removed.

A suffix array of all documents would take many times their size. It's made in independent parts instead, each by the
difference-cover algorithm (`suffix_order`): a run's part is chosen by its content, namely by the least hash of the
`KMER`-byte strings in it (a minimizer), so all equal runs, wherever they start, come to one part. Neighbouring starts
mostly have the same minimizer; such a stretch of starts travels as one window of text. A minimizer that occurs once
in all documents can't be that of a repeated run, and its text never moves. A minimizer with more than `HOT` windows is split
further, again by content: by the bytes around it that lie in the run wherever in its class the run starts.

Windows that are equal from end to end are combined first, by digest in the task that reads them and by their bytes in
the part: all but the earliest are repeats as a whole. Which runs of what is left are repeated is decided by the suffix array:
adjacent suffixes are compared on their first `LENGTH` bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvellum.llm.common import chained, mix, row_slices, short_batches, string_bytes, table

LENGTH, KMER = 100, 40
SPAN = LENGTH - KMER + 1
#: Text of whole minimizers that one suffix array takes together, in bytes.
PART_BYTES = 150_000
#: Windows that a task remembers to have sent, and spans that it gathers before it passes them on.
SENT = 200_000
#: Windows of a minimizer from which on it's split, and starts that are split alike; their runs have LENGTH - STEP bytes in common.
HOT, STEP = 10_000, 10
_ROW = "id long, tid long, key long, place long"
_COLUMNS = ["id", "tid", "key", "place", "x"]
#: Rounds of naming after which names cover LENGTH bytes or more (3, 9, 27, 81, 243).
ROUNDS = 5
_R = np.uint64(0x9E3779B97F4A7C15)
_NO_ID = -(2**63)


# ---- the difference-cover algorithm -------------------------------------------------------------------------------


def suffix_order(t: np.ndarray, rounds: int) -> np.ndarray:
    """Suffixes of ``t`` (values from 1 on) in an order that is right on at least the first 3**rounds values.

    Suffixes at places not divisible by 3 are sorted by triples and named; where names repeat, the row of names is
    sorted in the same way. The other suffixes are sorted by their first value and the rank of what follows, and both
    are merged by looking up how many sampled suffixes go before each of the others.
    """
    n = len(t)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), np.int64)
    s = np.concatenate([t, np.zeros(3, np.int64)])
    place = np.arange(n + (n % 3 == 1))
    one, two = place[place % 3 == 1], place[place % 3 == 2]
    sample = np.concatenate([one, two])
    key = _packed(s[sample], s[sample + 1], s[sample + 2])
    order = np.argsort(key)
    fresh = np.append(True, key[order][1:] != key[order][:-1])
    name = np.empty(len(sample), np.int64)
    name[order] = np.cumsum(fresh)
    if not fresh.all() and rounds > 1:
        order = suffix_order(name, rounds - 1)
        name[order] = np.arange(1, len(order) + 1)
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = name
    sampled = sample[order]
    sampled = sampled[sampled < n]
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(_packed(s[rest], rank[rest + 1]))]
    ones, twos = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    both = _packed(np.concatenate([s[rest], s[ones]]), np.concatenate([rank[rest + 1], rank[ones + 1]]))
    before = np.searchsorted(np.sort(both[len(rest) :]), both[: len(rest)])
    both = _packed(*(np.concatenate([x[rest + d], x[twos + d]]) for x, d in ((s, 0), (s, 1), (rank, 2))))
    before += np.searchsorted(np.sort(both[len(rest) :]), both[: len(rest)])
    slot = np.arange(len(rest)) + np.maximum.accumulate(before) if len(rest) else before
    out = np.full(n, -1, np.int64)
    out[slot] = rest
    out[out < 0] = sampled
    return out


def _packed(*columns: np.ndarray) -> np.ndarray:
    """One integer for each row of columns, in the same order; ranks are taken where the values don't fit together."""
    key = columns[0]
    for c in columns[1:]:
        width = int(c.max()) + 1 if len(c) else 1
        if len(key) and (int(key.max()) + 1) * width >= 2**63:
            key = np.unique(key, return_inverse=True)[1]
        key = key * width + c
    return key


def repeated_starts(texts: list[bytes], starts: list[int], first: list[tuple[int, int, int]]) -> list[np.ndarray]:
    """For each of different windows, given as text and number of starts from its first byte on: whether the run at
    each start also starts earlier in another window, or in this one; ``first`` has each window's earliest place (id, digest of the text, start)."""
    if not texts:
        return []
    size = np.array([len(x) + 1 for x in texts])
    begin = np.cumsum(size) - size
    raw = np.frombuffer(b"\0".join(texts) + b"\0" * 9, np.uint8)
    t = raw[: int(size.sum())].astype(np.int64) + 2
    t[begin + size - 1] = 1
    order = suffix_order(t, ROUNDS)
    window = np.repeat(np.arange(len(texts)), size)
    offset = np.arange(len(t)) - begin[window]
    order = order[offset[order] < np.array(starts)[window[order]]]
    # the first LENGTH bytes of neighbours, eight at a time
    eight = np.ndarray((len(raw) - 7,), "<u8", raw.tobytes(), strides=(1,))
    same = np.ones(max(len(order) - 1, 0), bool)
    for d in [*range(0, LENGTH - 7, 8), LENGTH - 8]:
        here = eight[order + d]
        same &= here[1:] == here[:-1]
    run = np.cumsum(np.append(True, ~same)) - 1 if len(order) else np.zeros(0, np.int64)
    doc, text, at = (np.array(x, np.int64) for x in zip(*first, strict=True))
    by_place = np.lexsort((at[window[order]] + offset[order], text[window[order]], doc[window[order]], run))
    lead = np.append(True, run[by_place][1:] != run[by_place][:-1]) if len(order) else np.zeros(0, bool)
    repeated = np.zeros(len(t), bool)
    repeated[order[by_place[~lead]]] = True
    return [repeated[b : b + k] for b, k in zip(begin.tolist(), starts, strict=True)]


# ---- windows of equal minimizer -----------------------------------------------------------------------------------

_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = np.uint64(pow(int(_R), -1, 2**64))
        _POWERS[:] = [np.cumprod(np.append(np.uint64(1), np.full(n, x, np.uint64))) for x in (_R, inverse)]
    return _POWERS[0], _POWERS[1]


def _hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """Of each string of ``size`` bytes, wherever it stands."""
    n = len(raw)
    up, down = _powers(n)
    sums = np.append(np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n]))
    return mix((sums[size:] - sums[:-size]) * down[: n - size + 1])


def split(x: bytes, key: int) -> list[tuple[int, int, int]]:
    """(first start, number of starts, key) of the parts of a window of a minimizer that has very many.

    The starts of a part lie up to `STEP` bytes apart before the same place of the minimizer, so all their runs have the
    same LENGTH - STEP bytes around it; their hash is the new key. Equal runs have equal ones, whatever window they are in.
    """
    raw = np.frombuffer(x, np.uint8)
    start = np.arange(len(raw) - LENGTH + 1)
    at = np.flatnonzero(_hashes(raw, KMER).view(np.int64) == key)
    next_at = at[np.searchsorted(at, start)]
    begin = next_at - (next_at - start) // STEP * STEP
    lo = np.flatnonzero(np.append(True, begin[1:] != begin[:-1]))
    keys = mix(_hashes(raw, LENGTH - STEP)[begin[lo]] ^ np.uint64(key % 2**64)).view(np.int64)
    return list(zip(lo.tolist(), np.diff(np.append(lo, len(start))).tolist(), keys.tolist(), strict=True))


def windows(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, minimizer, first start in the row, number of starts, whether the minimizer occurs in it twice or more) of
    the stretches of starts with one minimizer."""
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none, none
    hashes = least = _hashes(raw, KMER)
    # least of SPAN neighbours, by doubling
    reach = 1
    while reach < SPAN:
        step = min(reach, SPAN - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[: n - LENGTH + 1]
    fits = np.arange(n - LENGTH + 1) + LENGTH <= off[1:][row]
    fresh = np.ones(len(least), bool)
    fresh[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    fresh &= fits
    lo = np.flatnonzero(fresh)
    if not len(lo):
        return none, none, none, none, none
    count = np.add.reduceat(fits.astype(np.int64), lo)
    # a text with a short period has its minimizer again before the stretch ends, or within reach of its last start
    key = least[lo]
    again = np.add.reduceat(((hashes[: len(least)] == least) & fits).astype(np.int64), lo)
    last = lo + count - 1
    for d in range(1, SPAN):
        again += hashes[last + d] == key
    return row[lo], key.view(np.int64), lo - off[row[lo]], count, (again > 1).astype(np.int64)


def _all_windows(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            raw, off = string_bytes(batch.column(2))
            for a, b in row_slices(off):
                row, key, lo, n, again = windows(raw[off[a] : off[b]], off[a : b + 1] - off[a])
                at = pa.array(row + a)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(key), pa.array((lo << 32) | (n << 1) | again)], names=_COLUMNS[:-1])

    return docs.mapInArrow(run, _ROW)


def _window_texts(placed: DataFrame) -> DataFrame:
    """Windows with their text, equal ones combined before they move: one that a task has sent from an earlier place
    is a repeat from end to end, so only its span goes on, as a row without text."""

    def run(batches):
        import xxhash

        sent: dict[bytes, tuple[int, int, int]] = {}
        for batch in batches:
            raw, off = string_bytes(batch.column(2))
            held = batch.column(3)
            w = held.flatten()
            doc = np.repeat(np.arange(batch.num_rows), held.value_lengths().to_numpy())
            ids, tids, place, hot = batch.column(0).to_numpy()[doc], batch.column(1).to_numpy()[doc], w.field(1).to_numpy(), w.field(2).to_numpy(zero_copy_only=False)
            size = ((place & 0xFFFFFFFF) >> 1) + LENGTH - 1
            for a in range(0, len(w), 4096):
                part = slice(a, a + 4096)
                ends = np.append(0, np.cumsum(size[part])).astype(np.int32)
                spot = np.repeat(off[doc[part]] + (place[part] >> 32) - ends[:-1], size[part]) + np.arange(ends[-1])
                data = raw[spot].tobytes()
                cut = ends.tolist()
                known = np.zeros(len(cut) - 1, bool)
                for i, (x, y, at) in enumerate(zip(cut[:-1], cut[1:], zip(ids[part].tolist(), tids[part].tolist(), (place[part] >> 32).tolist(), strict=True), strict=True)):
                    digest = xxhash.xxh3_128_digest(data[x:y])
                    first = sent.get(digest)
                    if first is None or at < first:
                        sent[digest] = at
                    else:
                        known[i] = at != first
                if len(sent) > SENT:
                    sent.clear()
                x = pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)])
                key = w.field(0).slice(a, 4096)
                yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(tids[part]), key, w.field(1).slice(a, 4096), x], names=_COLUMNS).filter(pa.array(~known & ~hot[part]))
                for i in np.flatnonzero(~known & hot[part]).tolist():
                    y, lo = data[cut[i] : cut[i + 1]], int(place[a + i] >> 32)
                    rows = [(int(ids[a + i]), int(tids[a + i]), k, (lo + s) << 32, y[s : s + n + LENGTH - 1]) for s, n, k in split(y, key[i].as_py())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.binary()], strict=True)], names=_COLUMNS)
                if known.any():
                    begin = place[part][known] >> 32
                    span = pa.array((begin << 32) | (begin + size[part][known]))
                    lone, text = ids[part][known], tids[part][known]
                    spread = mix(lone.view(np.uint64) ^ mix(text.view(np.uint64))).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(lone), pa.array(text), pa.array(spread), span, pa.nulls(len(lone), pa.binary())], names=_COLUMNS)

    return placed.mapInArrow(run, f"{_ROW}, x binary")


class _Part:
    """Windows of some minimizers: each text once, with its earliest place. Later places of a text are known to be
    repeats from end to end, so what is held doesn't grow with them."""

    def __init__(self):
        self.held: dict[bytes, tuple[int, int, int]] = {}
        self.found: list[tuple[int, int, int]] = []
        self.bytes = 0

    def add(self, x: bytes, place: tuple[int, int, int]) -> None:
        first = self.held.get(x)
        if first is None:
            self.held[x] = place
            self.bytes += len(x)
        elif place != first:
            doc, text, lo = max(first, place)
            self.held[x] = min(first, place)
            self.found.append((doc, text, (lo << 32) | (lo + len(x))))

    def spans(self) -> list[tuple[int, int, int]]:
        """(id, digest of the text, span) of removed runs."""
        texts, first = list(self.held), list(self.held.values())
        starts = [len(x) - LENGTH + 1 for x in texts]
        out = self.found
        for (doc, text, lo), flags in zip(first, repeated_starts(texts, starts, first), strict=True):
            if flags.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))).tolist()
                out += [(doc, text, ((lo + a) << 32) | (lo + b + LENGTH - 1)) for a, b in zip(edge[::2], edge[1::2], strict=True)]
        return out


def _removed(parts: DataFrame) -> DataFrame:
    def run(batches):
        part, last = _Part(), None

        def rows(found):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)] or [pa.array([], pa.int64())] * 3, names=["id", "tid", "span"])

        for batch in batches:
            for doc, text, key, place, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != last and part.bytes >= PART_BYTES:
                    yield rows(part.spans())
                    part = _Part()
                last = key
                if x is None:
                    part.found.append((doc, text, place))
                else:
                    part.add(x, (doc, text, place >> 32))
            if len(part.found) > SENT:
                yield rows(part.found)
                part.found = []
        yield rows(part.spans())

    return parts.mapInArrow(run, "id long, tid long, span long")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(id, tid, spans array<long>) of texts that lose bytes, over (id, tid, text); a span is (begin << 32) | end, spans may overlap."""
    spark = docs.sparkSession
    every = _all_windows(short_batches(docs))
    busy = every.groupBy("key").agg(F.sum(1 + F.col("place") % 2).alias("n")).where("n > 1").select("key", (F.col("n") > HOT).alias("hot"))
    held = every.join(busy, "key").groupBy("id", "tid").agg(F.collect_set(F.struct("key", "place", "hot")).alias("held"))
    held = chained(spark, held)
    text = _window_texts(docs.join(held, ["id", "tid"]).select("id", "tid", "text", "held"))
    parts = text.repartition("key").sortWithinPartitions("key").select(*_COLUMNS)
    return chained(spark, _removed(parts).groupBy("id", "tid").agg(F.collect_set("span").alias("spans")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept binary: what is left of each document's bytes.

    Runs are judged on the input; a run starts earlier in a smaller doc_id, or in the same document before. Null and
    empty texts, and those shorter than a run, lose nothing. A document is a doc_id with its text: rows that repeat a doc_id with
    other texts are documents of their own, which rank by a digest of the text; rows alike in both count as one, so
    they lose what starts earlier but not what they only share with each other. A null doc_id ranks first. Long texts are
    treated whole, other columns are ignored, an empty table gives no rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    d = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text).alias("tid"), text.alias("text"))
    both = d.join(repeated_spans(d), ["id", "tid"], "left").select(F.when(F.col("id") != _NO_ID, F.col("id")).alias("doc_id"), "text", "spans")

    def run(batches):
        for batch in batches:
            raw, off = string_bytes(batch.column(1))
            data = raw.tobytes()
            n, removed, count, kept = [], [], [], []
            for i, spans in enumerate(batch.column(2).to_pylist()):
                x = data[off[i] : off[i + 1]]
                at, left, k, gone = 0, [], 0, -1
                for a, b in sorted((s >> 32, min(s & 0xFFFFFFFF, len(x))) for s in spans or ()):
                    if a > gone and a < b:
                        left.append(x[at:a])
                        k += 1
                    gone = max(gone, b)
                    at = max(at, b)
                left.append(x[at:])
                y = b"".join(left)
                n.append(len(x)), removed.append(len(x) - len(y)), count.append(k), kept.append(y)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the runs of bytes that start earlier."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op10_suffix_dedup": op10_suffix_dedup}
SQL: dict[str, str] = {}
