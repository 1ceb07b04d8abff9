"""What the operators of this subpackage share: table access, shared storage, packed hashing."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of a text, as in the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share, as the cluster names it in ``spark.checkpoint.dir``.

    Where none is named, a local session gets a temporary one; on a cluster that would be a different folder on each
    machine, so it's an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="corvellum-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


#: Bytes of rows that go to Python in one Arrow batch. Texts are long: the usual 64 MB, held on both sides of the pipe by
#: each running task, is a good part of a small executor.
BATCH_BYTES = 8 << 20


def short_batches(df: DataFrame) -> DataFrame:
    """``df``, its session set to bound Arrow batches at `BATCH_BYTES`; no result depends on where batches end."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def words(text: Column) -> Column:
    """The words of a text (null: none) as an array."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, with as many underscores behind it as it takes to be no column of the frames in any case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session option for the length of a block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def chained(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The same rows behind a reliable checkpoint, so a lost executor costs one stage and plans stay short.

    Nothing reads the step's shuffle files after it, so Spark is told to delete them when it ends.
    """
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        return df.select("*").checkpoint()


# ---- byte-level hashing of whole Arrow string columns ---------------------------------------------------------

_P1, _P2, _P3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h *= _P1
    h ^= h >> np.uint64(27)
    h *= _P2
    h ^= h >> np.uint64(31)
    return h


def string_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and the n+1 offsets of its rows; nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def row_slices(off: np.ndarray, most: int = 200_000):
    """(begin, end) row ranges of about ``most`` bytes together, so that arrays over bytes stay in the cache; a row is whole."""
    begin = 0
    while begin < len(off) - 1:
        end = max(begin + 1, int(np.searchsorted(off, off[begin] + most, side="right")) - 1)
        yield begin, end
        begin = end


def word_hashes(raw: np.ndarray, off: np.ndarray, alphanumeric: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (A-Z lower-cased) of rows laid end to end, and the n+1 word offsets. Words are cut
    at ASCII white space, or, if ``alphanumeric``, at all of ASCII but letters and digits; each character of a script without
    spaces (Chinese, Japanese, Thai) is a word."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    low = raw + ((raw >= 65) & (raw <= 90)) * np.uint8(32)
    if alphanumeric:
        inside = (low >= 128) | ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57))
    else:
        inside = ~((low == 32) | ((low >= 9) & (low <= 13)))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    if (low >= 0xE0).any():
        for size, lead in ((3, _lone_characters(low)), (4, (low == 0xF0) & _followed(low, 0xA0, 0xB0))):
            at = np.flatnonzero(lead)
            begins[at] = True
            at = at[at + size < n] + size
            begins[at] |= inside[at]
    cuts = off[1:-1]
    cuts = cuts[cuts < n]
    begins[cuts] = inside[cuts]
    starts = np.flatnonzero(begins)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    step = np.arange(n, dtype=np.int64)
    base = np.zeros(n, np.int64)
    base[starts] = starts
    place = step - np.maximum.accumulate(base)
    block = place >> _BLOCK_BITS
    place &= (1 << _BLOCK_BITS) - 1
    value = (low.astype(np.uint64) + np.uint64(1)) * _powers(int(place.max()) + 1)[place]
    if block.any():  # a word of more than a block: each block's bytes count with a factor of their own
        value *= mix(block.astype(np.uint64)) | np.uint64(1)
    value[~inside] = 0
    return mix(np.add.reduceat(value, starts)), np.searchsorted(starts, off)


#: Words are hashed in blocks of 2^20 bytes, which bounds the table of powers.
_BLOCK_BITS = 20
_POWERS = np.ones(1, np.uint64)


def _followed(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """Where the next byte is from ``a`` up to ``b``."""
    out = np.zeros(len(x), bool)
    out[:-1] = (x[1:] >= a) & (x[1:] < b)
    return out


def _lone_characters(x: np.ndarray) -> np.ndarray:
    """First bytes of characters from U+3000 to U+9FFF and of Thai ones, in UTF-8."""
    return ((x >= 0xE3) & (x <= 0xE9)) | ((x == 0xE0) & _followed(x, 0xB8, 0xBA))


def _powers(n: int) -> np.ndarray:
    """1, p, p^2 ... modulo 2^64, at least n of them."""
    global _POWERS
    while len(_POWERS) < n:
        _POWERS = np.concatenate([_POWERS, _POWERS * (_POWERS[-1:] * _P3)])
    return _POWERS
