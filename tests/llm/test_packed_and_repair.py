"""Packed token ids against the tokenizers library, and conversation repair against exhaustive search and SQL."""

import itertools
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvellum.llm import chat_repair, packed_ids

# ---- 11 packed ids


@given(bits=st.integers(1, 57), n=st.integers(0, 70), seed=st.integers(0, 9))
@settings(max_examples=200, deadline=None)
def test_packing_is_exact(bits, n, seed):
    ids = np.random.default_rng(seed).integers(0, 2**bits, n, dtype=np.uint64)
    data = packed_ids.pack(ids, bits)
    assert len(data) == -(-n // 8) * bits and (packed_ids.unpack(data, bits, n) == ids).all()


def test_chunks_are_read_from_anywhere():
    ids = np.random.default_rng(1).integers(0, 50257, 30_000, dtype=np.uint64)
    ends = np.array([0, 0, 10, 9000, 9000, 30_000])
    c = packed_ids.Chunk(packed_ids.chunk(ids, ends, packed_ids.width(50257)))
    assert (c.bits, c.n_ids) == (16, 30_000)
    for a, b in [(0, 1), (4095, 4097), (8192, 8192), (12_345, 30_000), (29_999, 40_000), (30_000, 30_001)]:
        assert (c.ids(a, b) == ids[a:b]).all()
    assert [len(c.document(k)) for k in range(6)] == [0, 0, 10, 8990, 0, 21_000]
    with pytest.raises(ValueError):
        packed_ids.chunk(np.array([65_536]), np.array([1]), 16)
    with pytest.raises(ValueError):
        packed_ids.Chunk(b"x" * 100)


def test_words_are_encoded_as_the_library_does():
    encoder = packed_ids.Encoder("")
    rng = random.Random(3)
    letters = [*" \n\t\0ab'sé漢1.!<|　\x1c\x85​", "<|endoftext|>", "w" * 50]
    texts = ["", "a <|endoftext|> b", *("".join(rng.choices(letters, k=rng.randint(0, 14))) for _ in range(5000))]
    for _ in range(2):  # new words, then known ones
        ids, ends = encoder.encode(texts, 2)
        want = [[*e.ids, 2] for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == want


def test_words_that_are_forgotten_are_learned_again(monkeypatch):
    monkeypatch.setattr(packed_ids, "KNOWN", 3)
    encoder = packed_ids.Encoder("")
    for text in ("one two three four five", "one six", "two seven"):
        assert encoder.encode([text], 2)[0].tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 2]


def _plain(texts):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [[*e.ids, 2] for e in t.encode_batch(texts, add_special_tokens=False)]


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_every_document_against_the_library(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    ids = _plain([d.text or "" for d in docs])
    starts = itertools.accumulate(map(len, ids), initial=0)
    want = [(d.doc_id, s, len(i), _crc(i)) for d, s, i in zip(docs, starts, ids, strict=False)]
    got = packed_ids.op11_packed_ids(spark, sf)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert [tuple(r) for r in got.orderBy("start").collect()] == want


def test_files_of_odd_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packed_ids, "CHUNK_IDS", 50)
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [(5, "b"), (None, "x y"), (1, None), (3, long), (3, "other"), (3, "other"), (2, ""), (None, None), (4, "a  \n b"), (7, "end"), (6, "漢字" * 300)]
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id int, text string, shard int, ids string").repartition(3)
    packed_ids.write_ids(docs, f"{tmp_path}/ids")
    got = packed_ids.read_documents(spark, f"{tmp_path}/ids").orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 1, 2, 3, 3, 3, 4, 5, 6, 7]
    assert sorted((r.doc_id or 0, list(r.ids)) for r in got) == sorted((i or 0, ids) for (i, t), ids in zip(rows, _plain([t or "" for _, t in rows]), strict=True))
    flat = [i for r in got for i in r.ids]
    assert all(r.start == sum(x.n_tokens for x in got[:k]) and r.n_tokens == len(r.ids) and r.ids_crc32 == _crc(r.ids) for k, r in enumerate(got))
    for a, b in [(0, 1), (3, 4200), (len(flat) - 5, len(flat) + 9), (7, 7), (len(flat), len(flat) + 1), (0, len(flat))]:
        pieces = packed_ids.read_range(spark, f"{tmp_path}/ids", a, b).collect()
        assert [i for p in pieces for i in p.ids] == flat[a:b]
        assert not pieces or pieces[0].position == a
    packed_ids.write_ids(docs.where("false"), f"{tmp_path}/none")
    assert packed_ids.read_documents(spark, f"{tmp_path}/none").count() == 0
    assert packed_ids.read_range(spark, f"{tmp_path}/none", 0, 9).count() == 0


# ---- 12 conversation repair


def _by_search(turns):
    """The least (cost, audit) over all edits with at most two inserted turns in a gap."""
    best = None

    def walk(i, roles, cost, audit, inserted):
        nonlocal best
        if best and cost > best[0]:
            return
        if not ("s" not in roles[1:] and _pairs(roles)):
            return
        if i == len(turns) and len(roles.removeprefix("s")) % 2 == 0 and roles != "s":
            best = min(best or (cost, audit), (cost, audit))
        if inserted < 2:
            for r in "ua":
                walk(i, roles + r, cost + 3, audit + "I", inserted + 1)
        if i < len(turns):
            ini, fault = turns[i]
            walk(i + 1, roles, cost + 4, audit + "D", 0)
            if fault not in ("blank", "duplicate"):
                more = 3 if fault else 0
                walk(i + 1, roles + (ini or "-"), cost + more, audit + "K", 0)
                for r in "ua":
                    walk(i + 1, roles + r, cost + 3 + more, audit + "R", 0)

    def _pairs(roles):
        return all(r == "ua"[k % 2] for k, r in enumerate(roles.removeprefix("s")))

    walk(0, "", 0, "", 0)
    return best


def test_cheapest_against_exhaustive_search():
    rng = random.Random(5)
    for _ in range(400):
        turns = [(rng.choice(["s", "u", "a", "u", "a", "x", ""]), rng.choice(["", "", "", "truncated", "blank", "duplicate"])) for _ in range(rng.randint(0, 5))]
        assert chat_repair.cheapest(turns) == _by_search(turns), turns


def test_audits_compare_like_strings():
    rng = random.Random(2)
    nodes = [chat_repair.Audit(None, "")]
    children = {}
    for _ in range(3000):
        parent, letter = rng.choice(nodes[-40:]), rng.choice("DIKR")
        if (id(parent), letter) not in children:
            children[id(parent), letter] = chat_repair.Audit(parent, letter)
            nodes.append(children[id(parent), letter])
    for _ in range(3000):
        a, b = rng.choice(nodes), rng.choice(nodes)
        assert (a < b) == (str(a) < str(b))


def test_a_long_conversation():
    turns = [("u", ""), ("a", "")] * 20_000
    turns[10_000:10_000] = [("s", "")]
    cost, audit = chat_repair.cheapest(turns)
    assert cost == 4 and audit == "K" * 10_000 + "D" + "K" * 30_000


def test_repair_of_odd_conversations(spark):
    say = "Well said."
    rows = [
        (1, 0, "system", say), (1, 1, "user", say), (1, 1, "user", say), (1, 4, "assistant", "cut off"),
        (2, None, "assistant", say), (2, None, None, None), (3, 0, "system", say), (4, 0, "user", None), (None, 0, "user", say), (None, 1, "assistant", "A" * 300_000 + "."),
        (5, 0, "tool", say), (6, 3, "assistant", say), (6, 2, "user", say),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id int, turn int, role string, text string, cost int, turns string")
    got = {r.conv_id: r for r in chat_repair.repair_conversations(df).collect()}
    assert len(got) == 7
    assert (got[1].gaps, got[1].duplicate, got[1].truncated, got[1].illegal, got[1].cost, got[1].audit) == (2, 1, 1, 1, 7, "KKDK")
    assert (got[2].gaps, got[2].blank, got[2].illegal, got[2].audit, got[2].cost) == (0, 1, 1, "DIK", 7)
    assert got[2].turns == [("user", ""), ("assistant", say)]
    assert (got[3].audit, got[3].cost, got[3].turns) == ("D", 4, [])
    assert (got[4].audit, got[4].blank) == ("D", 1)
    assert got[None].audit == "KK" and len(got[None].turns[1].text) == 300_001
    assert (got[5].audit, got[5].turns) == ("D", []) and got[6].audit == "KK" and got[6].illegal == 0
    assert chat_repair.repair_conversations(df.where("false")).count() == 0


def test_null_rows_say_the_same_in_sql(spark, tmp_path, same_rows):
    import duckdb

    rng = random.Random(8)
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["Yes.", "No!", "well", " ", "", None, "a.\n"]
    rows = [(rng.choice([*range(60), None]), rng.choice([0, 1, 2, 3, 4, 9, None]), rng.choice(roles), rng.choice(texts)) for _ in range(300)]
    rows += [(900, 0, "user", "Yes."), (900, 0, "user", "Yes.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    same_rows(chat_repair.op12_chat_repair(spark, str(tmp_path)), con.sql(chat_repair.SQL["op12_chat_repair"]))


# ---- names of the operators' own columns


def test_columns_with_the_operators_own_names_pass_through(spark):
    from corvellum.llm import line_templates, unit_dedup

    line = "the same line of several words"
    rows = [(i, f"own words of number {i}\n{line}", *range(7)) for i in range(6)]
    names = ("__id__", "__tid__", "__gone__", "__found__", "found", "Dropped", "tid")
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    for out in (line_templates.drop_recurring_lines(docs), unit_dedup.remove_repeats(docs)):
        assert [c for c in out.columns if c not in ("n_repeated", "removed")] == docs.columns
        assert all(tuple(r[n] for n in names) == tuple(range(7)) for r in out.collect())
    assert sum(line in r.text for r in unit_dedup.remove_repeats(docs).collect()) == 1
    assert not any(line in r.text for r in line_templates.drop_recurring_lines(docs).collect())


def test_every_repeated_unit_is_removed(spark, sf):
    from corvellum.llm import unit_dedup

    out = unit_dedup.op2_substring_dedup(spark, sf).collect()
    whole = unit_dedup.remove_repeats(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert sum(r.n_repeated for r in out) == sum(x["units"] for r in whole for x in r.removed) > 0
    assert all(r.n_cut == sum(x["length"] for x in w.removed) and r.n_removed <= r.n_cut for r, w in zip(sorted(out, key=lambda r: r.doc_id), sorted(whole, key=lambda r: r.doc_id), strict=True))
