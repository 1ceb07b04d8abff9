"""SentencePiece BPE encoding and decoding as rounds of array operations over all new words of a batch at once.

The vocabulary's pieces, scores and kinds are read from the library; merging and decoding are done here.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corvellum.llm.common import short_batches, table

SPACE = "▁"
NONE = np.int32(2**31 - 1)
#: Characters of words kept with their ids in a Python worker; beyond it the cache starts anew. Longer words aren't kept.
CACHED_CHARS, LONGEST_CACHED = 3_000_000, 64
#: Symbols from which on a segment of a word is merged by lists of places, not by looking at all of it in each round.
LONG = 2048
#: Texts that one round of array operations takes together, in characters.
BATCH_CHARS = 500_000


class PieceCodec:
    """Encoder and decoder for one BPE model with byte fallback, an identity normaliser and a leading dummy space."""

    made: dict[str, PieceCodec] = {}

    def __init__(self, path: str):
        import public_tokenizers
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        n = sp.vocab_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
        ids = {p: i for i, p in enumerate(pieces) if normal[i]}
        scores, dense = np.unique([-sp.get_score(i) for i in range(n)], return_inverse=True)
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("pieces that hold a space after another character can't be cut at words")
        # characters: the piece of each; those that have none are numbered from n on and never merge
        self.of_char = np.full(0x110000, -1, np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        lone = sorted({c for p in ids for c in p} - ids.keys())
        for k, c in enumerate(lone):
            self.of_char[ord(c)] = n + k
        symbol = ids | {c: n + k for k, c in enumerate(lone)}
        self.width = np.int64(n + len(lone) + 1)
        pairs = [(symbol[p[:k]], symbol[p[k:]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        left, right, whole = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        key = left * self.width + right
        order = np.argsort(key)
        self.keys, self.whole = key[order], whole[order].astype(np.int32)
        rank_of = np.append(dense, np.zeros(len(lone) + 1)).astype(np.int32)
        self.ranks = rank_of[self.whole]
        # A merge may be done at all its places in a word at once unless it can lead to one that goes first,
        # or another piece has the same rank.
        early = np.zeros(len(scores), bool)
        for side in (left, right):
            early[rank_of[side[rank_of[whole] <= rank_of[side]]]] = True
        early |= np.bincount(dense, minlength=len(scores)) > 1
        self.one_by_one = early
        self.byte_id = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        text = [p.replace(SPACE, " ").encode() if normal[i] else bytes([int(p[1:-1], 16)]) if sp.is_byte(i) else b"" for i, p in enumerate(pieces)]
        self.piece_len = np.array([len(t) for t in text], np.int64)
        self.piece_at = np.cumsum(self.piece_len) - self.piece_len
        self.piece_bytes = np.frombuffer(b"".join(text), np.uint8)
        unmergeable = "".join(sorted({chr(c) for c in range(128) if self.of_char[c] < 0}))
        stop = re.escape(unmergeable)
        self.words = re.compile(f"{SPACE}*[^{SPACE}{stop}]+|{SPACE}+|[{stop}]")
        # neighbouring characters that some piece holds; no merge can ever join others
        self.neighbours = np.array(sorted({ord(a) * 0x110000 + ord(b) for p in ids for a, b in zip(p, p[1:], strict=False)}), np.int64)
        self.cache: dict[str, bytes] = {}
        self.cached_chars = 0

    @classmethod
    def get(cls, path: str) -> PieceCodec:
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    # ---- encoding -------------------------------------------------------------------------------------------

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of adjacent symbols; NONE where they don't merge."""
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        fits = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(fits, self.ranks[at], NONE), self.whole[at]

    def merge_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit integers: rounds of segmented minima, merges and compaction.

        Words are cut between neighbours that no piece holds, so that a very long word is many short segments, which
        take their rounds together.
        """
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        sym = self.of_char[chars]
        char_at = np.arange(len(chars), dtype=np.int64)
        pair = chars[:-1].astype(np.int64) * 0x110000 + chars[1:]
        known = self.neighbours[np.minimum(np.searchsorted(self.neighbours, pair), len(self.neighbours) - 1)] == pair
        last = np.append((owner[1:] != owner[:-1]) | ~known, True)
        word = np.cumsum(np.append(0, last[:-1]))
        done_sym, done_char = [], []
        size = np.bincount(word)
        if len(size) and size.max() > LONG:
            ends = np.cumsum(size)
            for k in np.flatnonzero(size > LONG).tolist():
                part = slice(ends[k] - size[k], ends[k])
                merged, kept = self._merge_long(sym[part])
                done_sym.append(merged), done_char.append(char_at[part][kept])
            stay = size[word] <= LONG
            sym, char_at, last, word = (x[stay] for x in (sym, char_at, last, word))
        rank, whole = self._look(sym, np.append(sym[1:], -1))
        rank[last] = NONE
        while len(sym):
            starts = np.flatnonzero(np.append(True, last[:-1]))
            size = np.diff(np.append(starts, len(sym)))
            least = np.minimum.reduceat(rank, starts)
            # words in which nothing merges any more leave the arrays
            over = np.repeat(least == NONE, size)
            if over.any():
                done_sym.append(sym[over]), done_char.append(char_at[over])
                stay = ~over
                word, sym, char_at, last, rank, whole = (x[stay] for x in (word, sym, char_at, last, rank, whole))
                going = least != NONE
                least, size = least[going], size[going]
                if not len(sym):
                    break
            best = np.repeat(least, size)
            hit = np.flatnonzero(rank == best)
            # leftmost first: of a run of adjacent hits every other one; of a word to be taken singly, the first hit
            new_run = np.append(True, np.diff(hit) != 1)
            begin = np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))
            take = (np.arange(len(hit)) - begin) % 2 == 0
            single = self.one_by_one[best[hit]]
            if single.any():
                first = np.append(True, word[hit][1:] != word[hit][:-1])
                take = np.where(single, first, take)
            hit = hit[take]
            sym[hit] = whole[hit]
            last[hit] |= last[hit + 1]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            at = np.cumsum(keep)[hit] - 1
            word, sym, char_at, last, rank, whole = (x[keep] for x in (word, sym, char_at, last, rank, whole))
            redo = np.unique(np.concatenate([at, at[at > 0] - 1]))
            rank[redo], whole[redo] = self._look(sym[redo], sym[np.minimum(redo + 1, len(sym) - 1)])
            rank[last] = NONE
        sym, char_at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_sym, done_char))
        order = np.argsort(char_at)
        sym, char_at = sym[order], char_at[order]
        return self._spell(len(words), owner[char_at], sym, chars[char_at])

    def _merge_long(self, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged symbols of one long segment, and the places that are left. The rounds are those of `merge_words`, but each
        looks only at the places that wait for its rank, and at their neighbours."""
        sym, n = sym.copy(), len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank, whole = self._look(sym, np.append(sym[1:], -1))
        rank[-1] = NONE
        waiting: dict[int, list] = {}  # arrays of places, or, of a rank that is taken singly, a heap of them
        heap: list[int] = []

        def wait(places: np.ndarray) -> None:
            r = rank[places]
            order = np.argsort(r, kind="stable")
            cuts = np.flatnonzero(np.diff(r[order])) + 1
            for group in np.split(places[order], cuts):
                if len(group) and (own := int(rank[group[0]])) != NONE:
                    if own not in waiting:
                        heapq.heappush(heap, own)
                    queue = waiting.setdefault(own, [])
                    if self.one_by_one[own]:
                        for place in group.tolist():
                            heapq.heappush(queue, place)
                    else:
                        queue.append(group)

        wait(np.arange(n))
        while heap:
            r = heap[0]
            if self.one_by_one[r]:
                hit = np.array([heapq.heappop(waiting[r])])
                if not waiting[r]:
                    del waiting[heapq.heappop(heap)]
                if rank[hit[0]] != r:
                    continue
            else:
                hit = np.unique(np.concatenate(waiting.pop(heapq.heappop(heap))))
                hit = hit[rank[hit] == r]
                if not len(hit):
                    continue
                new_run = np.append(True, after[hit[:-1]] != hit[1:])
                begin = np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - begin) % 2 == 0]
            gone = after[hit]
            sym[hit] = whole[hit]
            rank[gone] = NONE
            sym[gone] = -2
            after[hit] = after[gone]
            inner = after[hit] < n
            before[after[hit][inner]] = hit[inner]
            redo = np.unique(np.concatenate([hit, before[hit][before[hit] >= 0]]))
            right = after[redo]
            rank[redo], whole[redo] = self._look(sym[redo], np.where(right < n, sym[np.minimum(right, n - 1)], -1))
            wait(redo)
        kept = np.flatnonzero(sym != -2)
        return sym[kept], kept

    def _spell(self, n: int, word: np.ndarray, sym: np.ndarray, char: np.ndarray) -> list[bytes]:
        """Symbols as ids, characters without a piece as the ids of their UTF-8 bytes, cut at words."""
        plain = (sym >= 0) & (sym < len(self.piece_len))
        size = np.where(plain, 1, 1 + (char >= 0x80) + (char >= 0x800) + (char >= 0x10000)).astype(np.int64)
        ends = np.cumsum(size)
        ids = np.zeros(int(ends[-1]) if len(ends) else 0, "<u4")
        ids[(ends - size)[plain]] = sym[plain]
        odd = np.flatnonzero(~plain)
        if len(odd):
            data = np.frombuffer("".join(map(chr, char[odd].tolist())).encode(), np.uint8)
            spot = np.repeat((ends - size)[odd], size[odd])
            spot += np.arange(len(spot)) - np.repeat(np.cumsum(size[odd]) - size[odd], size[odd])
            ids[spot] = self.byte_id[data]
        counts = np.bincount(word, weights=size, minlength=n).astype(np.int64)
        cut = np.append(0, np.cumsum(counts)) * 4
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text with the begin and end ids, packed as little-endian unsigned 32-bit integers."""
        cut = [self.words.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if self.cached_chars > CACHED_CHARS:
            self.cache.clear()
            self.cached_chars = 0
        new = list({w for words in cut for w in words if w not in self.cache})
        if new:
            self.cache.update(zip(new, self.merge_words(new), strict=True))
        begin, end, got = int(self.bos).to_bytes(4, "little"), int(self.eos).to_bytes(4, "little"), self.cache.__getitem__
        out = [b"".join([begin, *map(got, words), end]) for words in cut]
        for w in new:
            if len(w) > LONGEST_CACHED:
                del self.cache[w]
            else:
                self.cached_chars += len(w)
        return out

    # ---- decoding -------------------------------------------------------------------------------------------

    def decode(self, packed: list[bytes]) -> list[bytes]:
        """UTF-8 text of each packed run of ids: bytes gathered piece by piece, without the leading dummy space."""
        ids = np.frombuffer(b"".join(packed), "<u4").astype(np.int64)
        size = self.piece_len[ids]
        ends = np.cumsum(size)
        place = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size)
        data = self.piece_bytes[np.repeat(self.piece_at[ids], size) + place].tobytes()
        counts = np.cumsum([len(p) // 4 for p in packed])
        stop = np.where(counts > 0, np.append(0, ends)[counts], 0).tolist() if len(packed) else []
        return [data[a:b].removeprefix(b" ") for a, b in zip([0, *stop[:-1]], stop, strict=True)]


def _slices(texts: list[str]):
    """Neighbouring texts of about BATCH_CHARS together."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BATCH_CHARS:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def encode_documents(docs: DataFrame, model: str = "", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """All columns of ``docs`` but its text, plus n_tokens, ids array<int> (with begin and end ids; left out unless
    ``with_ids``), ids_sha256, decoded_sha256. One pass, no shuffle.

    A null text counts as empty and has the begin and end ids only. Very long texts, and words of any length, are
    encoded whole. Repeated rows stay; an empty table gives no rows. A column of the input that has the name of a
    new one gives way to it.
    """
    made = ["n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    kept = [f for f in docs.schema.fields if f.name not in (*made, text_col)]

    def run(batches):
        codec = PieceCodec.get(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            for a, b in _slices(texts):
                packed = codec.encode(texts[a:b])
                decoded = codec.decode(packed)
                ids = pa.ListArray.from_arrays(np.append(0, np.cumsum([len(p) // 4 for p in packed])).astype(np.int32), pa.array(np.frombuffer(b"".join(packed), "<i4")))
                columns = [c.slice(a, b - a) for c in batch.columns[:-1]]
                columns += [pa.array([len(p) // 4 for p in packed], pa.int64()), *([ids] if with_ids else [])]
                columns += [pa.array([hashlib.sha256(p).hexdigest() for p in x]) for x in (packed, decoded)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [f.name for f in kept] + [m for m in made if with_ids or m != "ids"]
    kinds = dict(zip(made, ("long", "array<int>", "string", "string"), strict=True))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{m} {kinds[m]}" for m in names[len(kept) :]])
    return short_batches(docs).select(*[docs[f"`{f.name}`"] for f in kept], docs[text_col]).mapInArrow(run, schema)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, and decoded again from its ids."""
    return encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False)


QUERIES = {"op4_sentencepiece": op4_sentencepiece}
SQL: dict[str, str] = {}
