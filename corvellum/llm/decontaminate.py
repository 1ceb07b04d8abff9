"""Benchmark decontamination: pigeonhole pieces, exact piece hits, Myers' bit-parallel distance on what was hit.

The alphabet is words (A-Z lower-cased, cut at ASCII punctuation and white space, and each character of a script without
spaces). An item of m words may be found
with up to k = floor(`ERRORS` * m) word edits. Cut into k + 1 pieces, at least one piece must occur unchanged, so the
pieces' exact hits miss nothing; each hit is verified in the window that the item could lie in.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvellum.llm.common import chained, row_slices, short_batches, string_bytes, table, word_hashes

ERRORS = 0.2
#: Characters of items that travel to the tasks together; a larger benchmark is matched in several passes, one at a time.
BLOCK_CHARS = 16_000_000
_JOIN = np.uint64(0x9E3779B97F4A7C15)


def distance_in(pattern: list[int], text: list[int], most: int) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any run of ``text``, and the end of that run; ``most`` + 1 if it's more.

    Myers' recurrence on Python integers, one bit for each word of the pattern, however long it is.
    """
    m = len(pattern)
    ones, top = (1 << m) - 1, 1 << (m - 1)
    eq: dict[int, int] = {}
    for i, w in enumerate(pattern):
        eq[w] = eq.get(w, 0) | (1 << i)
    vp, vn, score, best, end = ones, 0, m, m, 0
    for j, w in enumerate(text):
        x = eq.get(w, 0) | vn
        d0 = ((vp + (x & vp)) ^ vp) | x
        hn = vp & d0
        hp = vn | (ones & ~(vp | d0))
        score += bool(hp & top) - bool(hn & top)
        x = (hp << 1) & ones
        vn = x & d0
        vp = ((hn << 1) & ones) | (ones & ~(x | d0))
        if score < best:
            best, end = score, j + 1
    return (best, end) if best <= most else (most + 1, 0)


class Items:
    """Benchmark items as words, and all their pieces by hash. An item too short for an edit is one piece, found exactly."""

    last: tuple[object, Items | None] = (None, None)

    @classmethod
    def get(cls, name: str, items: list[tuple[int, str]], errors: float) -> Items:
        """The block of this name, kept in the Python worker until another one comes."""
        if cls.last[0] != name:
            cls.last = name, cls(items, errors)
        return cls.last[1]

    def __init__(self, items: list[tuple[int, str]], errors: float = ERRORS):
        raw, off = string_bytes(pa.array([t for _, t in items], pa.large_string()))
        h, at = word_hashes(raw, off, alphanumeric=True)
        self.ids = [i for i, _ in items]
        self.words = [h[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        self.budget = [int(len(w) * errors + 1e-9) for w in self.words]
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for i, (w, k) in enumerate(zip(self.words, self.budget, strict=True)):
            if len(w):
                cuts = [len(w) * p // (k + 1) for p in range(k + 2)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    pieces.setdefault(b - a, []).append((int(self._joined(w[a:b])), i, a))
        self.by_length = {}
        for n, rows in sorted(pieces.items()):
            rows.sort()
            keys = np.array([r[0] for r in rows], np.uint64)
            seen = np.zeros(1 << 20, bool)
            seen[(keys >> np.uint64(44)).astype(np.int64)] = True
            self.by_length[n] = keys, seen, np.array([r[1:] for r in rows], np.int64)

    @staticmethod
    def _joined(w: np.ndarray) -> np.uint64:
        out = w[:1]
        for x in w[1:]:
            out = out * _JOIN + x
        return out[0]

    def scan(self, h: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(row, item, distance, end word) of all finds in rows of words; the best of each item in a row."""
        windows: dict[tuple[int, int], list[tuple[int, int]]] = {}
        run = h
        for n in range(1, max(self.by_length, default=0) + 1):
            if n > 1:
                if len(run) < 2:
                    break
                run = run[:-1] * _JOIN + h[n - 1 :]
            if n not in self.by_length:
                continue
            keys, seen, rows = self.by_length[n]
            spot = np.flatnonzero(seen[(run >> np.uint64(44)).astype(np.int64)])
            lo, hi = np.searchsorted(keys, run[spot]), np.searchsorted(keys, run[spot], side="right")
            hit = hi > lo
            spot, lo, hi = spot[hit], lo[hit], hi[hit]
            row = np.searchsorted(at, spot, side="right") - 1
            whole = spot + n <= at[row + 1]
            for s, r, a, b in zip(spot[whole].tolist(), row[whole].tolist(), lo[whole].tolist(), hi[whole].tolist(), strict=True):
                for item, offset in rows[a:b].tolist():
                    k, m = self.budget[item], len(self.words[item])
                    windows.setdefault((r, item), []).append((max(int(at[r]), s - offset - k), min(int(at[r + 1]), s - offset + m + k)))
        found = []
        for (r, item), spans in windows.items():
            spans.sort()
            joined = [list(spans[0])]
            for a, b in spans[1:]:
                if a <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], b)
                else:
                    joined.append([a, b])
            pattern, k = self.words[item].tolist(), self.budget[item]
            best = min((d, a + end - int(at[r])) for a, b in joined for d, end in [distance_in(pattern, h[a:b].tolist(), k)])
            if best[0] <= k:
                found.append((r, item, *best))
        return sorted(found)


def _blocks(benchmark: DataFrame, block_chars: int) -> tuple[int, Iterator[tuple[str, list[tuple[int, str]]]]]:
    """How many blocks of a bounded size the items make, and the blocks, each with a name, one in memory at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = int(chars // block_chars) + 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return n, ((uuid.uuid4().hex, [tuple(r) for r in items.where(part == b).collect()]) for b in range(n))


def find_leaks(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Found items: doc_id, item_id, distance (word edits), budget, item_words, end_word (of the find in the text).

    One row per document and item, the best find (then the leftmost). No shuffle: the benchmark travels to the texts,
    in blocks of a bounded size; with several, each block's finds are written before the next one is read. Null and
    empty texts and items match nothing; items too short for an edit (four words and less) are found as they are; a
    text of any length is searched whole. Repeated rows are found alike; a null doc_id stays null; other columns are
    ignored; an empty table on either side gives no rows.
    """
    out = None
    n, blocks = _blocks(benchmark, block_chars)
    for name, items in blocks:
        one = short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_finder(name, items, errors), "doc_id long, item_id long, distance int, budget int, item_words int, end_word int")
        one = one if n == 1 else chained(docs.sparkSession, one)
        out = one if out is None else out.unionByName(one)
    return out


def _finder(name: str, rows: list[tuple[int, str]], errors: float):
    def run(batches):
        items = Items.get(name, rows, errors)
        for batch in batches:
            raw, off = string_bytes(batch.column(1))
            found = []
            for a, b in row_slices(off):
                h, at = word_hashes(raw[off[a] : off[b]], off[a : b + 1] - off[a], alphanumeric=True)
                found += [(a + r, *rest) for r, *rest in items.scan(h, at)]
            cols = list(zip(*found, strict=True)) or [(), (), (), ()]
            item = cols[1]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array([items.ids[i] for i in item], pa.int64()), pa.array(cols[2], pa.int32()),
                    pa.array([items.budget[i] for i in item], pa.int32()), pa.array([len(items.words[i]) for i in item], pa.int32()), pa.array(cols[3], pa.int32()),
                ],
                names=["doc_id", "item_id", "distance", "budget", "item_words", "end_word"],
            )

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item; judged row by row where they lie, no shuffle.

    Blocks, odd texts and items are as in `find_leaks`; all columns stay, and a row without a doc_id is judged like any.
    """
    at = docs.columns.index("text")

    def without(name, rows):
        def run(batches):
            items = Items.get(name, rows, errors)
            for batch in batches:
                raw, off = string_bytes(batch.column(at))
                keep = np.ones(batch.num_rows, bool)
                for a, b in row_slices(off):
                    h, cut = word_hashes(raw[off[a] : off[b]], off[a : b + 1] - off[a], alphanumeric=True)
                    keep[[a + r for r, *_ in items.scan(h, cut)]] = False
                yield batch.filter(pa.array(keep))

        return run

    n, blocks = _blocks(benchmark, block_chars)
    for name, items in blocks:
        docs = short_batches(docs).mapInArrow(without(name, items), docs.schema)
        docs = docs if n == 1 else chained(docs.sparkSession, docs)
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in all documents."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op3_decontamination": op3_decontamination}
SQL: dict[str, str] = {}
