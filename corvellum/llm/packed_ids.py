"""Token ids in files of fixed-width bits.

An id takes as many bits as the greatest id of the vocabulary needs. Ids are packed in groups of eight, which is a whole number
of bytes at any width, the first id in the lowest bits (16 bits are little-endian 16-bit integers). A *chunk* holds
whole documents in order::

    magic "CVPK" | version u8 | bits u8 | ids in a block u16 | documents u64 | ids u64 | where data begins u64
    end of each document, in ids: u64 each | begin of each block, in bytes: u64 each | data

all little-endian. A reader takes any range of ids from the blocks that cover it. A set of documents is a Parquet folder of
chunks, in which file number, chunk number and position are ascending in doc_id: ``shard`` (a file), ``chunk``, ``begin`` (ids of
the shard before this chunk), ``n_ids``, ``doc_ids`` and ``data``. Where a shard begins among all ids is the running sum of
the shards' totals, so no task sees more than its own shard.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import sys
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvellum.llm.common import setting, shared_folder, short_batches, table

MAGIC, VERSION, HEAD = b"CVPK", 1, struct.Struct("<4sBBHQQQ")
#: Ids of a block, a multiple of eight.
BLOCK = 4096
#: A chunk is closed when it has so many ids; a longer document is one chunk.
CHUNK_IDS = 1 << 20
END_ID = 2
#: Words whose ids a task remembers, and the longest that it does, in characters.
KNOWN, KNOWN_CHARS = 3 << 19, 40
#: New words that are encoded together.
LINES = 500
#: Words to remember.
_PLAIN = re.compile(rf" ?\S{{1,{KNOWN_CHARS}}}").fullmatch
#: New words that are encoded together.
LINES = 500
#: Words to remember.
_PLAIN = re.compile(rf" ?\S{{1,{KNOWN_CHARS}}}").fullmatch
#: Where words can be cut without changing an id: a blank or line end between two characters that are no white space, as
#: a piece of the vocabulary's pattern has one blank in front at most and no other white space beside letters, digits or signs.
_BLANK, _LINE_END = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"(?<=\S)\n(?=\S)")
#: A text without any of these has only such blanks and line ends, but at its ends.
_ODD = ("  ", " \n", "\n ", "\n\n", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"))
_ODD_ASCII = tuple(x for x in _ODD if x.isascii())
_CHUNK = "shard int, chunk int, begin long, n_ids long, doc_ids array<long>, data binary"


# ---- packing ------------------------------------------------------------------------------------------------------


def width(size: int) -> int:
    """Bits for the ids of a vocabulary of ``size`` ids."""
    return max(1, (size - 1).bit_length())


def _bytes_of_group(bits: int):
    """(id in the group, byte in the group, shift to the left) of all bytes that a group of eight ids touches."""
    return [(j, k, j * bits - 8 * k) for j in range(8) for k in range(j * bits // 8, (j * bits + bits - 1) // 8 + 1)]


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids under 2**bits (at most 57 bits) in ``bits`` bits each, filled up with zeros to a group of eight."""
    groups = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    groups.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(groups), bits), np.uint8)
    for j, k, left in _bytes_of_group(bits):
        x = groups[:, j]
        out[:, k] |= ((x << np.uint64(left)) if left >= 0 else (x >> np.uint64(-left))).astype(np.uint8)
    return out.tobytes()


def unpack(data: bytes | memoryview, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of what `pack` made."""
    raw = np.frombuffer(data, np.uint8)[: -(-n // 8) * bits].reshape(-1, bits)
    out = np.zeros((len(raw), 8), np.uint64)
    for j, k, left in _bytes_of_group(bits):
        x = raw[:, k].astype(np.uint64)
        out[:, j] |= (x >> np.uint64(left)) if left >= 0 else (x << np.uint64(-left))
    return (out & np.uint64((1 << bits) - 1)).reshape(-1)[:n]


def chunk(ids: np.ndarray, ends: np.ndarray, bits: int) -> bytes:
    """A chunk of documents that end at ``ends`` among ``ids``; an id that needs more bits is an error."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} needs more than {bits} bits")
    blocks = -(-len(ids) // BLOCK)
    data = HEAD.size + 8 * (len(ends) + blocks)
    begins = data + np.arange(blocks, dtype="<u8") * (BLOCK * bits // 8)
    head = HEAD.pack(MAGIC, VERSION, bits, BLOCK, len(ends), len(ids), data)
    return b"".join([head, np.asarray(ends, "<u8").tobytes(), begins.tobytes(), pack(ids, bits)])


class Chunk:
    """Reads a chunk; nothing but the blocks that are asked for is unpacked."""

    def __init__(self, data: bytes):
        magic, version, self.bits, self.block, n_docs, self.n_ids, at = HEAD.unpack_from(data)
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError("not a chunk of packed ids")
        self.data = memoryview(data)
        self.ends = np.frombuffer(data, "<u8", n_docs, HEAD.size).astype(np.int64)
        self.begins = np.frombuffer(data, "<u8", (at - HEAD.size) // 8 - n_docs, HEAD.size + 8 * n_docs)

    def ids(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Ids from ``begin`` up to ``end``, cut to what there is."""
        end = self.n_ids if end is None else min(end, self.n_ids)
        if begin >= end:
            return np.zeros(0, np.uint64)
        first = begin // self.block
        skip = first * self.block
        return unpack(self.data[int(self.begins[first]) :], self.bits, end - skip)[begin - skip :]

    def document(self, k: int) -> np.ndarray:
        """Ids of the ``k``-th document."""
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


# ---- encoding -----------------------------------------------------------------------------------------------------


class _Numbers(dict):
    """Words to numbers in order of first use; a word that is looked up gets the next one and goes to ``fresh``."""

    fresh: list[str]

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


def words_of(text: str) -> list[str]:
    """Pieces that can be encoded apart, which together are the text."""
    if "\0" in text:
        return [text]
    if text[:1].isspace() or text[-1:].isspace() or any(odd in text for odd in (_ODD_ASCII if text.isascii() else _ODD)):
        return _LINE_END.sub("\0\n\0", _BLANK.sub("\0 ", text)).split("\0")
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


class Encoder:
    """Texts to ids with the tokenizers library, which sees each different word once while it's remembered; one to a Python worker."""

    made: dict[str, Encoder] = {}

    @classmethod
    def get(cls, path: str) -> Encoder:
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def __init__(self, path: str):
        import public_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task for each core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
        self.bits = width(self.tokenizer.get_vocab_size(with_added_tokens=True))
        # of each word by its number: where its ids begin, how many they are, how often it was met; and all ids in one row
        self.number = _Numbers()
        self.begins, self.sizes, self.met, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.used = 0

    def _put(self, first: int, at: int, sizes: np.ndarray, flat: np.ndarray) -> tuple[int, int]:
        """Places words from number ``first`` and id ``at`` on; where the next ones go."""
        end, stop = first + len(sizes), at + len(flat)
        if end > len(self.sizes):
            self.begins, self.sizes, self.met = (np.concatenate([x, np.zeros(end, np.int64)]) for x in (self.begins, self.sizes, self.met))
        if stop > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(stop, np.uint32)])
        self.sizes[first:end], self.met[first:end], self.flat[at:stop] = sizes, 0, flat
        self.begins[first:end] = at + np.cumsum(sizes) - sizes
        return end, stop

    def forget(self, least: int) -> None:
        """Forgets words that were met fewer than ``least`` times, and how often the others were."""
        n = len(self.number)
        stay = self.met[:n] >= least
        words, flat = list(itertools.compress(self.number, stay)), self.flat[: self.used][np.repeat(stay, self.sizes[:n])]
        self.number = _Numbers(zip(words, range(len(words)), strict=True))
        _, self.used = self._put(0, 0, self.sizes[:n][stay], flat)

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of different words, and their ids in one row. Words without inner white space are encoded as lines of one
        text, which the library does faster than word by word; the line end between them is an id of its own."""
        lines = ["\n".join(words[a : a + LINES]) + "\n" for a in range(0, len(words), LINES)]
        got = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        ids = np.concatenate(got) if got else np.zeros(0, np.uint32)
        cuts = np.flatnonzero(ids == self.tokenizer.token_to_id("\u010a"))
        if len(cuts) != len(words):
            raise ValueError("the vocabulary's pattern doesn't keep line ends apart")
        return np.diff(cuts, prepend=-1) - 1, np.delete(ids, cuts)

    def _ids_one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter(map(len, got), np.int64, len(got)), np.fromiter(itertools.chain.from_iterable(got), np.uint32)

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, ``end_id`` after each, and where each text ends."""
        if len(self.number) > KNOWN:
            self.forget(3)
            if len(self.number) > KNOWN // 2:
                self.forget(sys.maxsize)
        words, counts = [], []
        for text in texts:
            cut = words_of(text)
            words += cut
            counts.append(len(cut))
        first = len(self.number)
        self.number.fresh = fresh = []
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        stays = np.fromiter((_PLAIN(w) is not None for w in fresh), bool, len(fresh))
        plain, rest = list(itertools.compress(fresh, stays)), list(itertools.compress(fresh, ~stays))
        for w in rest:
            del self.number[w]
        self.number.update(zip(plain, range(first, first + len(plain)), strict=True))
        where = np.empty(len(fresh), np.int64)
        where[stays], where[~stays] = np.arange(len(plain)), len(plain) + np.arange(len(rest))
        new = at >= first
        at[new] = first + where[at[new] - first]
        new, self.used = self._put(first, self.used, *self._ids(plain))
        self._put(new, self.used, *self._ids_one_by_one(rest))
        times = np.bincount(at)
        self.met[: len(times)] += times
        begins, here = self.begins[at], self.sizes[at]
        ends = np.cumsum(here)
        ids = self.flat[np.repeat(begins - (ends - here), here) + np.arange(ends[-1] if len(ends) else 0)]
        of_text = ends[np.cumsum(counts) - 1] if counts else np.zeros(0, np.int64)
        return np.insert(ids, of_text, end_id), of_text + np.arange(1, len(texts) + 1)


def write_ids(docs: DataFrame, folder: str, tokenizer: str = "", end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text, appends ``end_id`` and writes chunks to a new ``folder``, ascending in doc_id.

    Texts are dealt out by ranges of (doc_id, digest of the text), encoded and packed where they arrive; a task holds one Arrow
    batch and one chunk. A null text is empty and has the end id alone; a null doc_id ranks first; rows that repeat a
    doc_id all stay, ordered by a digest of their texts, so they too are split between tasks (rows alike in both are
    interchangeable and follow each other in one task, which streams them). Very long texts are encoded whole and make a chunk
    of their own size. Other columns are ignored, whatever their names. An empty table writes no rows.
    """

    def run(batches):
        from pyspark import TaskContext

        shard, encoder = TaskContext.get().partitionId(), Encoder.get(tokenizer)
        held_docs, held_ids, held_ends, n, begin, number = [], [], [], 0, 0, 0

        def done():
            data = chunk(np.concatenate(held_ids), np.concatenate(held_ends), encoder.bits)
            docs_of = pa.ListArray.from_arrays(pa.array([0, sum(map(len, held_docs))], pa.int32()), pa.concat_arrays(held_docs))
            columns = [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([begin], pa.int64()), pa.array([n], pa.int64()), docs_of, pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["shard", "chunk", "begin", "n_ids", "doc_ids", "data"])

        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            size = pc.binary_length(texts).to_numpy(zero_copy_only=False).cumsum()
            a = 0
            while a < len(texts):
                b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + CHUNK_IDS)))
                ids, ends = encoder.encode(texts[a:b].to_pylist(), end_id)
                held_docs.append(batch.column(0)[a:b]), held_ids.append(ids), held_ends.append(ends + n)
                n, a = n + len(ids), b
                if n >= CHUNK_IDS:
                    yield done()
                    begin, number = begin + n, number + 1
                    held_docs, held_ids, held_ends, n = [], [], [], 0
        if n:
            yield done()

    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{text_col}`")).alias("h"))
    dealt = d.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    with setting(docs.sparkSession, "spark.sql.parquet.compression.codec", "uncompressed"):
        short_batches(dealt).mapInArrow(run, _CHUNK).write.parquet(folder)


def _begins(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, first): ids of all shards before each; one small row a file."""
    totals = spark.read.parquet(folder).groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("first"))


def read_documents(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers) and,
    if ``with_ids``, ids array<int>, of each document of a folder of chunks. Chunks are read apart from each other; no id is moved."""

    def run(batches):
        for batch in batches:
            for shard, begin, doc_ids, data in zip(*(batch.column(k) for k in range(4)), strict=True):
                c = Chunk(data.as_py())
                ids = c.ids().astype("<u4")
                begins = np.append(0, c.ends[:-1])
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), c.ends.tolist(), strict=True)]
                columns = [doc_ids.values, pa.array(np.full(len(c.ends), shard.as_py(), np.int32)), pa.array(begins + begin.as_py()), pa.array(c.ends - begins), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, c.ends).astype(np.int32)), pa.array(ids.view("<i4"))))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kept = ["ids array<int>"] if with_ids else []
    schema = ["doc_id long", "shard int", "begin long", "n_tokens long", "ids_crc32 long", *kept]
    names = [c.split()[0] for c in schema]
    found = short_batches(spark.read.parquet(folder)).select("shard", "begin", "doc_ids", "data").mapInArrow(run, ", ".join(schema))
    return found.join(_begins(spark, folder), "shard").select("doc_id", (F.col("first") + F.col("begin")).alias("start"), *names[3:])


def read_range(spark: SparkSession, folder: str, begin: int, end: int) -> DataFrame:
    """(position, ids array<int>) pieces that together are the ids from ``begin`` up to ``end`` of all, in order of position.

    Chunks outside the range are not fetched: what each covers stands in its small columns, and of the chunks at the borders only
    the blocks in the range are unpacked. A range beyond the last id, or an empty one, gives no rows.
    """

    def run(batches):
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                a = max(begin - at, 0)
                ids = Chunk(data.as_py()).ids(a, end - at).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([at + a], pa.int64()), pa.array([ids], pa.list_(pa.int32()))], names=["position", "ids"])

    chunks = spark.read.parquet(folder)
    index = chunks.select("shard", "chunk", "begin", "n_ids").join(_begins(spark, folder), "shard").withColumn("at", F.col("first") + F.col("begin"))
    wanted = index.where((F.col("at") < end) & (F.col("at") + F.col("n_ids") > begin)).select("shard", "chunk", "at")
    return chunks.select("shard", "chunk", "data").join(wanted, ["shard", "chunk"]).select("at", "data").mapInArrow(run, "position long, ids array<int>").orderBy("position")


def op11_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, number of ids and their checksum, read back from the files."""
    folder = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents"), folder)
    return read_documents(spark, folder, with_ids=False)


QUERIES = {"op11_packed_ids": op11_packed_ids}
#: Byte-pair merges have no SQL; the tests compare with the library.
SQL: dict[str, str] = {}
