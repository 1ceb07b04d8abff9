"""Operators of the training-data pipeline against SQL, brute force, or an exact round trip; and their odd inputs."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvellum.llm import chat_format, components, decontaminate, license_scan, line_templates, order_minhash, pieces, quality, registry, stages, suffix_dedup, unit_dedup, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty texts, ties and repeated rows, a very long text, and a column of a clashing name."""
    long_text = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, PROSE), (3, PROSE), (4, PROSE), (5, "x"), (6, long_text), (7, "   \n\n "), (None, PROSE), (8, "Released under the MIT License.\n" + PROSE)]
    return spark.createDataFrame([(i, t, None, "s", None, "clash", 7) for i, t in rows], DOCS + ", score string, unit int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql_says_the_same(name, spark, sf, duck, same_rows):
    same_rows(registry.QUERIES[name](spark, sf), duck.sql(registry.SQL[name]))


# ---- 1 URL filters


def test_urls(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.COM/en/x?q#f", "http://www.example.com/en/", "http://x.net/es/1", "http://x.net", "ftp://free-casino.org/", "http://freecasino.org/", "http://a.org/xxx", "a://b://c/d"]
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id int, url string, verdict string")
    got = {r.page_id: r for r in url_filter.judge_urls(df).collect()}
    j = {i: (r.url_judgement.host, r.url_judgement.path, r.url_judgement.rule, r.url_judgement.verdict) for i, r in got.items()}
    assert j[0] == j[1] == j[2] == ("", "", None, "allow")
    assert j[3] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert j[4] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert j[5] == ("x.net", "/es/1", "net/es/", "block") and j[6] == ("x.net", "", None, "allow")
    assert j[7][3] == "block" and j[8][3] == "allow" and j[9][3] == "block" and j[10][:2] == ("b:", "//c/d")
    assert all(r.verdict == "mine" for r in got.values())
    assert url_filter.judge_urls(df.where("false")).count() == 0
    long = "http://x.com/" + "a" * 300_000 + "/xxx"
    twice = spark.createDataFrame([(1, long, "a"), (1, long, "a"), (2, "http://x.net/spiel", "b")], "page_id int, url string, url_judgement string")
    out = url_filter.judge_urls(twice, rules=())
    assert out.columns.count("url_judgement") == 1 and [r.url_judgement.verdict for r in out.orderBy("page_id").collect()] == ["block", "block", "allow"]
    strict, soft = url_filter.vocabulary(spark.createDataFrame([("Spiel", True), ("spiel", False), ("a", None), (None, True), ("", True)], "term string, strict boolean"))
    assert (strict, soft) == (["spiel"], ["a"])
    assert [r.url_judgement.verdict for r in url_filter.judge_urls(twice, (), strict, soft).orderBy("page_id").collect()] == ["allow", "allow", "block"]


# ---- 2 substring dedup


def test_units_keep_the_earliest(spark, odd, empty):
    df = spark.createDataFrame([(2, "a b c d\nq\n A  B c D "), (1, "x y z w\na b c d"), (None, "x y z w")], "doc_id long, text string")
    got = sorted((r.doc_id, r.unit, r.start, r.length, r.words, r.kept_doc_id, r.kept_unit) for r in unit_dedup.repeated_units(df, "line").collect())
    assert got == [(1, 0, 0, 7, 4, None, 0), (2, 0, 0, 7, 4, 1, 1), (2, 2, 10, 10, 4, 1, 1)]
    left = {r.doc_id: (r.text, len(r.removed)) for r in unit_dedup.remove_repeats(df, "line").collect()}
    assert left == {2: ("\nq\n", 2), 1: ("\na b c d", 1), None: ("x y z w", 0)}
    two = spark.createDataFrame([(1, "a b c d\n\ne f\ng h"), (2, "E f\ng h\n\nz")], "doc_id long, text string")
    assert [(r.doc_id, r.unit, r.start, r.length) for r in unit_dedup.repeated_units(two, "paragraph").collect()] == [(2, 0, 0, 7)]


def test_short_units_are_deduplicated_too(spark):
    df = spark.createDataFrame([(1, "Menu\nHome\none two"), (2, "home\n漢字。漢字。"), (3, "漢字。")], "doc_id long, text string")
    out = {r.doc_id: (r.text, r.n_repeated) for r in unit_dedup.remove_repeats(df).collect()}
    assert out == {1: ("Menu\nHome\none two", 0), 2: ("\n漢字。", 2), 3: ("", 1)}


def test_hot_units_are_found_alike(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted(map(tuple, unit_dedup.repeated_units(docs).collect()))
    monkeypatch.setattr(unit_dedup, "HOT", 20)
    assert sorted(map(tuple, unit_dedup.repeated_units(docs).collect())) == want and len(want) > 100


def test_a_passage_over_lines_goes_and_a_lone_line_stays(spark):
    lines = [f"The {k}th line of a passage has its own words{k}. And so has its second sentence number{k}." for k in range(4)]
    passage, lone = "\n".join(lines), "Subscribe to our newsletter now!"
    rows = [(1, f"First of all {passage} and so on."), (2, f"Some other text\n{lone}\nhere. Then {passage}\nThe end of it"), (3, f"{lone}\nNothing else in common here.")]
    out = {r.doc_id: r for r in unit_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), min_words=unit_dedup.PASSAGE_WORDS).collect()}
    assert out[1].text == rows[0][1] and out[3].text == rows[2][1] and out[3].n_repeated == 1
    (run,) = out[2].removed
    assert run.words > 50 and run.kept_doc_id == 1 and out[2].text == rows[1][1][: run.start] + rows[1][1][run.start + run.length :]
    assert "passage" in out[2].text and "2th" not in out[2].text and out[2].text.startswith("Some other text\n" + lone)


def test_units_of_odd_rows(spark, odd, empty):
    out = unit_dedup.remove_repeats(odd.withColumn("removed", F.lit(1)))
    assert out.columns == [*odd.columns, "n_repeated", "removed"] and out.count() == odd.count()
    left = [(r.doc_id, r.text) for r in out.collect()]
    assert (None, PROSE) in left and left.count((3, "")) == 2 and (1, None) in left and (4, "") in left and (7, "   \n\n ") in left
    assert unit_dedup.remove_repeats(empty).count() == 0
    twice = spark.createDataFrame([(1, "a b. c d."), (1, "a b. e f.")], "doc_id long, text string")
    assert sorted(r.text for r in unit_dedup.remove_repeats(twice).collect()) in (["a b. c d.", " e f."], [" c d.", "a b. e f."], sorted(["a b. c d.", " e f."]), sorted([" c d.", "a b. e f."]))


# ---- 3 decontamination


def _infix(a, t):
    p = list(range(len(a) + 1))
    best = p[-1]
    for y in t:
        q = [0]
        for i, x in enumerate(a, 1):
            q.append(min(p[i] + 1, q[-1] + 1, p[i - 1] + (x != y)))
        p, best = q, min(best, q[-1])
    return best


def test_leaks_match_brute_force(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    cut = lambda t: re.findall("[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    items = [(r.item_id, cut(r.text)) for r in bench.collect()]
    rng = random.Random(7)
    rows = [(r.doc_id, r.text) for r in docs.where("length(text) < 3000").limit(30).collect()]
    for k, (_, w) in enumerate(items[:12]):
        w = list(w)
        for _ in range(rng.randint(0, len(w) // 3)):
            w[rng.randrange(len(w))] = "zz"
        rows.append((1000 + k, "Before that. " + " ".join(w).upper() + " and after."))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = set()
    for d, t in rows:
        for i, w in items:
            k = int(len(w) * decontaminate.ERRORS + 1e-9)
            e = _infix(w, cut(t))
            if w and e <= k:
                want.add((d, i, e))
    for block in (decontaminate.BLOCK_CHARS, 2000):
        assert {(r.doc_id, r.item_id, r.distance) for r in decontaminate.find_leaks(df, bench, block_chars=block).collect()} == want
    kept = {r.doc_id for r in decontaminate.drop_leaks(df, bench).collect()}
    assert kept == {d for d, _ in rows} - {d for d, *_ in want} and len(want) >= 5


def test_leaks_odd(spark, odd, empty):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "two three"), (4, PROSE)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(odd, bench).collect()} == {(d, i) for d in (3, 4, 8, None) for i in (3, 4)}
    many = spark.createDataFrame([(i, f"word{i}") for i in range(20)], "item_id long, text string")
    texts = spark.createDataFrame([(i, f"it has word{i} in it") for i in range(30)], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.find_leaks(texts, many, block_chars=30).collect()) == [(i, i) for i in range(20)]
    assert {r.doc_id for r in decontaminate.drop_leaks(texts, many, block_chars=30).collect()} == set(range(20, 30))
    lone = spark.createDataFrame([(1, "前文今天天气非常好我们去公园散步吧后文"), (2, "昨天")], "doc_id long, text string")
    assert {r.doc_id for r in decontaminate.find_leaks(lone, spark.createDataFrame([(7, "今天天气真的好我们去公园散步吧")], "item_id long, text string")).collect()} == {1}
    assert decontaminate.drop_leaks(odd, bench).columns == odd.columns
    assert decontaminate.find_leaks(empty, bench).count() == 0 and decontaminate.find_leaks(odd, bench.where("false")).count() == 0


def test_word_hashes():
    from corvellum.llm.common import string_bytes, word_hashes

    import pyarrow as pa

    big = "x" * (1 << 20)
    texts = ["A b  c", "a B c", "", "漢字 ab漢c", "漢 字 ab 漢 c", "ไทย", "𠀀𠀁", big + "12", big + "21", big + "12" + big, "é漢", "\u3000"]
    h, at = word_hashes(*string_bytes(pa.array(texts)))
    got = [h[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    assert got[0] == got[1] and got[2] == [] and got[3] == got[4] and len(got[3]) == 5 and len(got[5]) == 3 and len(got[6]) == 2
    assert got[7] != got[8] and len({tuple(g) for g in got[7:10]}) == 3 and len(got[10]) == 2


# ---- 4 SentencePiece


def test_pieces_equal_the_library(spark, sf, odd, empty):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(3)
    alphabet = "ab  \n\t▁éß漢😀\x00<s>/0xthe ing aaaa    "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["", "a" * 3000, " " * 500, "\n" * 40, "the" * 900] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    codec = pieces.PieceCodec.get("")
    want = sp.encode(texts, add_bos=True, add_eos=True)
    got = codec.encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want
    assert [d.decode() for d in codec.decode(got)] == sp.decode(want)
    rows = pieces.encode_documents(odd).collect()
    assert len(rows) == odd.count() and {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {2}
    assert all(hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() == r.ids_sha256 for r in rows)
    assert pieces.encode_documents(empty).count() == 0


def test_long_words_equal_the_library():
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(9)
    texts = ["".join(rng.choice(parts) for _ in range(n)) for parts in (["th", "er", "ing", "tion", "on", "ed"], "acgt", "ab", "aaaab", "今天气é漢", [" ", "▁", "x"]) for n in (2100, 5000)]
    got = pieces.PieceCodec.get("").encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == sp.encode(texts, add_bos=True, add_eos=True)


# ---- 5 line templates


def test_templates(spark, odd, empty):
    rows = [(i, f"Posted by user{i} on day {i}\nunique words number {chr(97 + i)} here\nDone.") for i in range(6)] + [(20 + i, "same text whole\ncopied") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = lambda **k: {r.doc_id: r.dropped for r in line_templates.recurring_lines(df, **k).collect()}
    assert got() == {i: [0, 1, 2] for i in range(6)}
    assert got(keep_first=True) == {i: [0, 1, 2] for i in range(1, 6)}
    assert line_templates.drop_recurring_lines(odd).columns == odd.columns and line_templates.drop_recurring_lines(odd).count() == odd.count()
    assert line_templates.recurring_lines(empty).count() == 0
    uneven = spark.createDataFrame([(i % 6, "a b c d\n" * (1 + i % 5) + f"own {chr(97 + i)}") for i in range(20)] + [(None, "a b c d")], "doc_id long, text string")
    assert all(0 <= x <= 5 for r in line_templates.recurring_lines(uneven).collect() for x in r.dropped)
    assert line_templates.drop_recurring_lines(uneven).where("doc_id IS NULL AND text = 'a b c d'").count() == 1


def test_a_leaf_holds_several_templates(spark):
    """Two templates with a variable word each and the same opening, and lines of that opening that recur nowhere."""
    names = [f"{chr(97 + k)}{chr(97 + k)}" for k in range(8)]
    rows = [(k, f"By the way {x} has left this room for good today\nBy the way nobody may open gates of {x} castle again") for k, x in enumerate(names)]
    rows += [(100 + k, "By the way " + " ".join(f"{x}{chr(97 + j)}" for j in range(8))) for k, x in enumerate(names)]
    got = {r.doc_id: r.dropped for r in line_templates.recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: [0, 1] for k in range(8)}


def test_lines_go_by_text_where_ids_repeat(spark):
    rows = [(k, f"All rights reserved here {k}\nown {chr(97 + k)}") for k in range(6)] + [(0, "something else\nof the same id")]
    out = line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.text for r in out.where("doc_id = 0").collect()} == {"own a", "something else\nof the same id"}


# ---- 6 licences


def test_licenses(spark, odd, empty):
    mit = license_scan.TEMPLATES[3][1]
    df = spark.createDataFrame([(1, "Hello.\n\n" + mit.replace(", ", ",\n") + "\n\nBye."), (2, mit.replace("granted", "given")), (3, "the mit license"), (4, None)], "doc_id long, text string")
    got = {(r.doc_id, r.scope, r.license) for r in license_scan.scan_licenses(df).collect()}
    assert (1, "paragraph", "MIT") in got and (2, "line", "MIT") in got and not {d for d, *_ in got} & {3, 4}
    assert {r.doc_id for r in license_scan.scan_licenses(odd).collect()} == {8}
    # inside a line, over several paragraphs, with text around, and with words put in
    bsd = license_scan.TEMPLATES[11][1].replace(": ", ":\n\n")
    more = [(1, "It was collected in 2019. This work is licensed under the GNU General Public License, version 3. Thanks to all."), (2, "code code code\n" + bsd + "\n\nint main() { return 0; }\n" * 30), (3, "We say: Released under the MIT License. " + "And so on it goes. " * 3000), (4, " ".join(w if k % 9 else w + " indeed" for k, w in enumerate(mit.split()))), (5, "released version under review, the license of mit")]
    windows = {(r.doc_id, r.license) for r in license_scan.scan_licenses(spark.createDataFrame(more, "doc_id long, text string")).where("scope = 'window'").collect()}
    assert windows == {(1, "GPL-3.0"), (2, "BSD-3-Clause"), (3, "MIT"), (4, "MIT")}
    assert license_scan.scan_licenses(empty).count() == 0


# ---- 7 Order MinHash


def _distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_band_equals_full_table():
    rng = random.Random(3)
    for _ in range(2000):
        a = [rng.randint(0, 3) for _ in range(rng.randint(0, 14))]
        b = list(a) if rng.random() < 0.6 else [rng.randint(0, 3) for _ in range(rng.randint(0, 14))]
        for _ in range(rng.randint(0, 4)):
            if b:
                b[rng.randrange(len(b))] = rng.randint(0, 3)
            if b and rng.random() < 0.3:
                del b[rng.randrange(len(b))]
        most, e = rng.randint(0, 8), _distance(a, b)
        assert order_minhash.banded_distance(a, b, most) == (e if e <= most else most + 1)
        if a:
            e = _infix(a, b)
            assert decontaminate.distance_in(a, b, most)[0] == (e if e <= most else most + 1)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)] + [(7, 7)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for e in edges for x in e}


def test_near_duplicates(spark, sf, odd, empty):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(500)]
    rows, truth = [], {}
    for g in range(30):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 200))]
        for k in range(rng.randint(1, 5)):
            w = list(base)
            for _ in range(k and len(w) // 25):
                w[rng.randrange(len(w))] = "edit"
            rows.append((len(rows), " ".join(w)))
            truth[len(rows) - 1] = g
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first = {}
    for d, g in sorted(truth.items()):
        first.setdefault(g, d)
    assert got == {d: first[g] for d, g in truth.items()}
    kept = order_minhash.keep_one_of_each(odd)
    assert kept.columns == odd.columns
    assert collections.Counter(r.doc_id for r in kept.collect()) == {1: 1, 3: 2, 5: 1, 6: 1, 7: 1, 8: 1, None: 1}
    assert order_minhash.near_duplicate_classes(empty).count() == 0


def test_recall_against_all_alike_pairs(spark, sf):
    """Of all pairs of different texts that share a five-word shingle and are alike, nine in ten end in one class or more; and
    texts of a class are connected by alike pairs."""
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    first, share = {}, collections.Counter()
    for r in docs.select("doc_id", "text").orderBy("doc_id").collect():
        first.setdefault(r.text, r.doc_id)
    cut = {d: (t or "").lower().split() for t, d in first.items()}
    holders = collections.defaultdict(set)
    for d, w in cut.items():
        for i in range(len(w) - 4):
            holders[tuple(w[i : i + 5])].add(d)
    for ids in holders.values():
        share.update((a, b) for a in ids for b in ids if a < b)
    code = {w: i for i, w in enumerate({w for ws in cut.values() for w in ws})}
    rows = {d: np.array([code[w] for w in ws], np.int64) for d, ws in cut.items()}
    alike = [(a, b) for a, b in share if order_minhash.alike(rows[a], rows[b], order_minhash.SIMILAR)]
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicate_classes(docs).collect()}
    assert len(alike) > 30 and np.mean([got[a] == got[b] for a, b in alike]) >= 0.9
    near = collections.defaultdict(set)
    for a, b in alike:
        near[a].add(b), near[b].add(a)
    for d in set(first.values()):
        seen, left = {d}, [d]
        while left:
            left += (new := near[left.pop()] - seen)
            seen |= new
        assert got[d] in seen


def _edited(rng, w, kind, share):
    """``w`` with ``share`` of its words put before, behind or inside, or so many replaced."""
    new = lambda: rng.getrandbits(64)
    k = round(share * len(w))
    if kind == "replaced":
        out = list(w)
        for i in rng.sample(range(len(w)), k):
            out[i] = new()
        return out
    at = {"before": 0, "behind": len(w), "inside": rng.randrange(len(w) + 1)}[kind]
    return w[:at] + [new() for _ in range(k)] + w[at:]


@pytest.mark.parametrize(("kind", "share"), [("before", 0.25), ("behind", 0.25), ("inside", 0.25), ("replaced", 0.05), ("replaced", 0.1), ("replaced", 0.15), ("replaced", 0.18)])
@pytest.mark.parametrize("size", [200, 40, 15, 10, 6])
def test_sketches_meet_for_alike_texts(kind, share, size):
    """Of pairs that are alike at 0.8, nine in ten or more share a sketch whose places can be true."""
    rng = random.Random(f"{kind} {share} {size}")
    found = []
    for _ in range(120):
        a = [rng.getrandbits(64) for _ in range(size)]
        b = _edited(rng, a, kind, share)
        x, y = (np.array(w, np.uint64) for w in (a, b))
        if not order_minhash.alike(x, y, 0.8):
            continue
        cut = np.append(0, np.cumsum([len(a), len(b)]))
        met = False
        for k, number in [(order_minhash.K, order_minhash.SKETCHES)] + [(order_minhash.SHORT_K, order_minhash.SHORT_SKETCHES)] * (max(len(a), len(b)) <= order_minhash.SHORT):
            keys, places = order_minhash.sketches(np.concatenate([x, y]), cut, k, number)
            (i, j), (p, q) = (places[0] >> 32, places[0] & 0xFFFFFFFF), (places[1] >> 32, places[1] & 0xFFFFFFFF)
            apart = abs(i - p) + abs((j - i) - (q - p)) + abs((len(a) - j) - (len(b) - q))
            met |= bool(((keys[0] == keys[1]) & (apart <= 0.2 * max(len(a), len(b)) + 1e-9)).any())
        bits = order_minhash.odd_classes(np.concatenate([x, y]), cut)
        assert int(np.bitwise_count(bits[0] ^ bits[1]).sum()) + abs(len(a) - len(b)) <= 2 * 0.2 * max(len(a), len(b)) + 1e-9
        found.append(met)
    assert not found or np.mean(found) >= 0.9, (len(found), np.mean(found))


def test_keys_of_a_row_do_not_depend_on_its_neighbours():
    rng = random.Random(4)
    rows = [np.array([rng.randrange(50) for _ in range(n)], np.uint64) for n in (0, 1, 3, 5, 6, 40, 0, 200)]
    at = np.append(0, np.cumsum([len(r) for r in rows]))
    keys, places = order_minhash.sketches(np.concatenate(rows), at)
    for i, r in enumerate(rows):
        alone, where = order_minhash.sketches(r, np.array([0, len(r)]))
        assert (keys[i] == alone[0]).all() and (places[i] == where[0]).all()
        if len(r) > 6:  # the least two k-mers anywhere, in the order of the text
            assert ((places[i] >> 32) < (places[i] & 0xFFFFFFFF)).all() and len(set(places[i].tolist())) > 10


def test_rows_that_repeat_an_id_are_judged_each_by_its_text(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a, 1, "x"), (2, a, 2, "x"), (2, b, 3, "x"), (None, a, 4, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tid int, class_id string")
    assert sorted(r[2] for r in order_minhash.keep_one_of_each(docs).collect()) == [1, 3, 4]
    assert {r.doc_id: r.class_id for r in order_minhash.near_duplicate_classes(docs).collect()} == {1: 1, 2: 1}


def test_texts_are_compared_with_all_members_of_a_large_class(spark, monkeypatch):
    """A long phrase repeated makes a class; texts at its fringe are like a few of its members only."""
    rng = random.Random(12)
    monkeypatch.setattr(order_minhash, "LARGE", 10)
    monkeypatch.setattr(order_minhash, "BLOCK", 7)
    word = lambda: f"v{rng.randrange(10**6)}"
    base, rows = [word() for _ in range(60)], []
    for k in range(40):
        own = [word() for _ in range(6 if k < 30 else 14)]
        rows.append((k, " ".join(base[: 60 - len(own)] + own)))
    fringe = [w.split() for _, w in rows[30:]]
    rows += [(50 + k, " ".join(w[:52] + [word() for _ in range(8)])) for k, w in enumerate(fringe)]
    cut = {d: np.array([hash(x) for x in t.split()]) for d, t in rows}
    parent = {d: d for d in cut}

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in cut:
        for b in cut:
            if a < b and order_minhash.alike(cut[a], cut[b], 0.8):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: top(d) for d in cut}


def test_no_bucket_leaves_pairs_untried(spark, monkeypatch):
    """One bucket for all: pairs of like texts among many that are unlike the bucket's centres, and texts of the next class."""
    rng = random.Random(11)
    rows = []
    for _ in range(40):
        w = [f"v{rng.randrange(9000)}" for _ in range(40)]
        rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(w[:7] + ["edit"] + w[8:]))]
    sketches = order_minhash._sketched
    monkeypatch.setattr(order_minhash, "_sketched", lambda *a: sketches(*a).withColumns({"keys": F.array(F.lit(1 << 32).cast("long")), "places": F.array(F.lit(0).cast("long"))}))
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d - d % 2 for d, _ in rows}


# ---- 8 quality


def test_quality(spark, sf, odd, empty):
    docs, trusted = spark.read.parquet(f"{sf}/documents.parquet"), quality.trusted_documents(spark, sf)
    rows = {r.doc_id: r for r in quality.judge_quality(docs, trusted).collect()}
    half = {r["__id__"]: r.half for r in quality.some_trusted(trusted).collect()}
    assert 0.3 < np.mean(list(half.values())) < 0.7 and set(half) == {r.doc_id for r in trusted.collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    n = quality.n_buckets(docs)
    assert quality.n_buckets(docs.unionAll(docs)) > n  # what is gathered grows with the corpus at every size
    raw, target, grams = collections.Counter(), collections.Counter(), {}
    cut = {d: re.findall(r"[^\x20\x09-\x0D]+", t) for d, t in texts.items()}
    one = {r.w: r.h for r in spark.createDataFrame([(w,) for w in sorted({w for ws in cut.values() for w in ws})], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    pairs = sorted({(one[a], one[b]) for ws in cut.values() for a, b in zip(ws, ws[1:], strict=False)})
    two = {(r.a, r.b): r.h for r in spark.createDataFrame(pairs, "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()}
    for d, ws in cut.items():
        h = [one[w] for w in ws]
        grams[d] = [x % n for x in h + [two[p] for p in zip(h, h[1:], strict=False)]]
        raw.update(grams[d])
        if half.get(d) == 1:
            target.update(grams[d])
    ratio = {b: np.log((target[b] + 1) / (target.total() + n)) - np.log((raw[b] + 1) / (raw.total() + n)) for b in raw}
    score = {d: np.mean([ratio[b] for b in grams[d]]) if ws else 0.0 for d, ws in cut.items()}
    held = [score[d] for d, h in half.items() if h == 0 and d in cut and len(cut[d]) >= quality.MIN_WORDS]
    low, mid = np.percentile(held, [100 * quality.LOW_QUANTILE, 50])
    limit = mid - quality.MARGIN * (mid - low)
    for d, ws in cut.items():
        seen = collections.Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
        covered = {j for i in range(len(ws) - 4) if seen[tuple(ws[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in texts[d].split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = rows[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", texts[d])), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(ws) < 10 or 100 * len(covered) > 20 * len(ws))
        assert abs(r.score - score[d]) < 1e-9 and abs(r.threshold - limit) < 1e-9 and r.kept == (not r.base_failed and r.score >= r.threshold)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = lambda q: np.mean([rows[d].kept for d, v in labels.items() if v == q])
    assert kept(1) > 0.93  # of bad ones this table has a dozen; see test_held_out_quality
    out = quality.judge_quality(odd, trusted.where("false"))
    assert out.count() == odd.count() and {c for c in out.columns if c == "score"} == {"score"}
    assert quality.judge_quality(empty, trusted).count() == 0
    assert quality.keep_good(docs, trusted).count() == sum(r.kept for r in rows.values())


def test_held_out_quality(spark, sf):
    """Documents that took no part in the model or the threshold: good ones stay, bad ones go."""
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    apart = F.pmod(F.xxhash64("doc_id", F.lit("test")), F.lit(3)) == 0
    judged = quality.judge_quality(docs, labels.where((F.col("quality") == 1) & ~apart).select("doc_id"))
    share = {r.quality: r.kept for r in judged.join(labels.where(apart), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1] > 0.93 and share[0] < 0.15


# ---- 9 chat formatting


def test_chats(spark):
    texts = ["", "\\", "\\\\[INST]", "</s>[INST] ok [/INST]", "[ROLE][TEXT]<s>", "[I\\NST]", "é😀\n", "[/[INST]INST]"]
    assert all(chat_format.unescape(chat_format.escape(t)) == t and not any(c in chat_format.escape(t) for c in chat_format.CONTROLS) for t in texts)
    roles = ["user", "assistant", "system", "tool[TEXT]", None, "assistant"]
    rows = [(c, (t if t else None), roles[(c + t) % 6], texts[(c * 3 + t) % 8] or None, "more") for c in range(6) for t in range(5)] + [(None, 1, "user", "x", "")]
    rows.append(rows[3])
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids string")
    out = chat_format.format_chats(df)
    read = {r.conv_id: r for r in chat_format.digests(out).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        d = read[conv]
        assert (d.n_turns, d.turns_sha256, d.loss_chars, d.loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.format_chats(df.where("false")).count() == 0 and chat_format.digests(chat_format.format_chats(df.where("false"))).count() == 0
    long = "word [INST] \\ " * 20_000
    r = chat_format.digests(chat_format.format_chats(spark.createDataFrame([(1, 0, "assistant", long)], "conv_id long, turn long, role string, text string"))).first()
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (1, len(long), hashlib.sha256(long.encode()).hexdigest())


# ---- 10 suffix arrays


def test_suffix_order():
    rng = random.Random(5)
    for _ in range(200):
        t = np.array([rng.randint(1, 3) for _ in range(rng.randint(0, 60))], np.int64)
        assert suffix_dedup.suffix_order(t, 9).tolist() == sorted(range(len(t)), key=lambda i, t=t: t[i:].tolist())
    t = np.array(([1, 2, 3, 1] * 500)[:1777], np.int64)
    assert suffix_dedup.suffix_order(t, 12).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def _kept(rows):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                cover[i : i + 100] = b"\1" * 100
            seen.add(b[i : i + 100])
        spans = sum(1 for i in range(len(b)) if cover[i] and not (i and cover[i - 1]))
        out[d] = len(b), sum(cover), spans, bytes(c for c, m in zip(b, cover, strict=True) if not m)
    return out


def test_suffix_dedup_matches_brute_force(spark, sf, empty, monkeypatch):
    rng = random.Random(5)
    rows = [(1, "ab" * 200), (2, "x" * 350), (3, None), (4, ""), (5, "ab" * 60 + "q" + "x" * 130), (6, "é" * 99), (7, "zé" * 99), (8, "é" * 99)]
    rows += [(9 + i, "".join(rng.choice("ab") for _ in range(300))) for i in range(5)]
    rows += [(30, rows[9][1][50:250] + rows[10][1][10:200]), (31, rows[9][1])]
    rows += [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(120).collect()]
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 20_000)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == _kept(rows)
    assert suffix_dedup.remove_repeats(empty).count() == 0
    twice = spark.createDataFrame([(1, "q" + PROSE * 3), (1, "q" + PROSE * 3), (None, PROSE * 2)], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(twice).count() == 3


def _kept_of(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect())


def test_rows_of_one_id_with_other_texts_are_other_documents(spark):
    rng = random.Random(9)
    x, y, z = ("".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(3))
    rows = [(1, x), (2, x), (2, y), (None, z), (None, y[:200]), (3, z + x)]
    got = {}
    for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id, r.n_bytes, r.n_removed] = bytes(r.kept).decode()
    # the text that two ids share stays with the first, and what null ids have stays with them
    assert got == {(1, 300, 0): x, (2, 300, 300): "", (2, 300, 200): y[200:], (None, 300, 0): z, (None, 200, 0): y[:200], (3, 600, 600): ""}


def test_minimizers_with_many_windows_are_split(spark, sf, monkeypatch):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    common, long = word(60), word(95)
    rows = [(i, word(rng.randint(20, 150)) + rng.choice([common, long]) + word(rng.randint(20, 150))) for i in range(150)]
    rows += [(200 + i, rows[i][1][10:]) for i in range(20)] + [(300, "ab" * 300), (301, "ab" * 200)]
    rows += [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()]
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _kept(rows)


def test_a_string_in_many_contexts_stays_within_a_part():
    """One 60-byte string in 20,000 contexts: no key of the split windows has more than a few of them."""
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz "
    common, bytes_of = "".join(rng.choice(letters) for _ in range(60)), collections.Counter()
    for _ in range(20_000):
        x = "".join(rng.choices(letters, k=90)) + common + "".join(rng.choices(letters, k=90))
        raw = np.frombuffer(x.encode(), np.uint8)
        for _, key, lo, n, _ in zip(*(a.tolist() for a in suffix_dedup.windows(raw, np.array([0, len(raw)]))), strict=True):
            window = x.encode()[lo : lo + n + 99]
            parts = suffix_dedup.split(window, key)
            assert sum(m for _, m, _ in parts) == n
            for s, m, k in parts:
                bytes_of[k] += len(window[s : s + m + 99])
    assert max(bytes_of.values()) < 2000


def test_suffix_dedup_on_odd_rows(spark, odd):
    """A null id first, repeated rows as one document, a text of 60,000 words that repeats itself, clashing columns."""
    given = {(-1 if r.doc_id is None else r.doc_id): r.text for r in odd.collect()}
    got = {(-1 if r.doc_id is None else r.doc_id): (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(odd.withColumn("kept", F.lit(1))).collect()}
    assert got == _kept(given.items()) and got[6][1] > 0.9 * got[6][0] > 250_000


# ---- pipeline


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(stages.STAGES) == 5
    now, kept = docs, {r.doc_id for r in quality.judge_quality(docs, quality.trusted_documents(spark, sf)).where("kept").collect()}
    texts = {}
    for k, (_, stage) in enumerate(stages.STAGES):
        out = stage(spark, now, sf).persist()
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        if k < 4:
            assert out.columns == docs.columns
        if k == 0:
            assert ids == kept
        if k == 1:
            assert ids == kept
            gone = {r.doc_id: r.dropped for r in line_templates.recurring_lines(now, keep_first=True).collect()}
            for r in now.collect():
                texts[r.doc_id] = "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in gone.get(r.doc_id, ()))
            assert {r.doc_id: r.text for r in out.collect()} == texts
        if k == 2:
            cut = {d: t.split() for d, t in texts.items()}
            for d in sorted(cut):
                near = [e for e in cut if e < d and abs(len(cut[e]) - len(cut[d])) <= 0.2 * max(len(cut[e]), len(cut[d]))]
                alone = all(order_minhash.banded_distance(cut[e], cut[d], m := int(0.2 * max(len(cut[e]), len(cut[d])) + 1e-9)) > m for e in near)
                if alone:
                    assert d in ids
        if k == 3:
            leaks = {r.doc_id for r in decontaminate.find_leaks(now, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
            assert ids == {r.doc_id for r in now.collect()} - leaks
        now = out
    codec = pieces.PieceCodec.get("")
    final = {r.doc_id: r for r in now.collect()}
    for d, r in final.items():
        assert np.array(r.ids, "<u4").tobytes() == codec.encode([texts[d]])[0]
        assert r.decoded_sha256 == hashlib.sha256(texts[d].encode()).hexdigest()
    assert {r.doc_id for r in stages.run(spark, sf).select("doc_id").collect()} == set(final)


def test_pipeline_on_odd_rows(spark, sf, odd, empty):
    good = {None, 3, 4, 6, 8}  # by the heuristics; the labels of other documents say which of these score well
    assert {r.doc_id for r in stages.quality_rules(spark, odd, sf).collect()} <= good and stages.quality_rules(spark, odd, sf).columns == odd.columns
    for now, want in ((odd.where("doc_id IS NULL OR doc_id IN (3, 4, 6, 8)"), [good, {None, 3, 6, 8}, {None, 3, 6, 8}, {None, 3, 6, 8}]), (empty, [set()] * 4)):
        columns = now.columns
        for (_, stage), ids in zip(stages.STAGES[1:], want, strict=True):
            out = stage(spark, now, sf).persist()
            assert {r.doc_id for r in out.select("doc_id").collect()} == ids
            if stage is not stages.encoding:
                assert out.columns == columns
                now = out
    assert stages.quality_rules(spark, empty, sf).count() == 0
    docs = spark.createDataFrame([(1, "All rights reserved.\none"), (2, None)], "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in stages.line_dedup(spark, docs, sf).collect()} == {(1, "All rights reserved.\none"), (2, None)}
