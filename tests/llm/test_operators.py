"""The operators against brute force and on nulls, empty and long texts, repeated rows, empty tables and clashing names."""

import base64
import hashlib
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from akshara.llm import fingerprints as FP
from akshara.llm.decontamination import contaminated, decontaminate
from akshara.llm.jaccard_join import Region, jaccard_components, near_duplicates_removed
from akshara.llm.language_id import Network, predict_language, train_network
from akshara.llm.packing import Levels, pack_documents
from akshara.llm.substring_dedup import substring_dedup
from akshara.llm.suffix_dedup import front_code, front_decode, merge_runs, reaches, shared, suffix_dedup
from akshara.llm.toxicity import score_toxicity, train_machine, train_toxicity
from akshara.llm.url_filters import filter_urls
from akshara.llm.warc import read_warc, shared_folder, write_warc

rng = np.random.default_rng(3)


@pytest.fixture(autouse=True)
def seeded():
    """Every test draws the same whatever ran before it."""
    global rng
    rng = np.random.default_rng(11)


VOCABULARY = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 7))) for _ in range(300)]
PASSAGE = " ".join(rng.choice(VOCABULARY, 90))


def prose(n):
    return " ".join(rng.choice(VOCABULARY, n))


BASE = prose(200)
TEXTS = [BASE, BASE, BASE + " tail words", "Head " + BASE, prose(30) + "\n" + PASSAGE + "\t" + prose(40), PASSAGE, prose(12) + "  " + PASSAGE, None, "", " \n\t", "one", "one two", "ab " * 300, prose(3000), "x" * 1500, "Ab AB ab " * 9]
SCHEMA = "doc_id long, text string, row string, key int, score double, `kept_text` string, `a.b` int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "r", i, 1.0, "k", i) for i, t in enumerate(TEXTS)]
    rows += [(2, TEXTS[2], "r", 2, 1.0, "k", 2), (None, BASE, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def order(row):
    return -1 if row.doc_id is None else row.doc_id


def test_substring_dedup(docs, empty):
    assert substring_dedup(empty).count() == 0
    first = {}
    for r in docs.collect():
        w = words(r.text)
        for p in range(len(w) - 19):
            k = tuple(w[p : p + 20])
            first[k] = min(first.get(k, (99, 0)), (order(r), p))
    out = substring_dedup(docs)
    assert {"row", "key", "score", "a.b"} <= set(out.columns) and out.columns.count("kept_text") == 1
    for r in out.collect():
        w = words(r.text)
        gone = {q for p in range(len(w) - 19) if first[tuple(w[p : p + 20])] < (order(r), p) for q in range(p, p + 20)}
        assert (r.n_words, r.n_removed, r.kept_text) == (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))


def test_substring_dedup_of_hot_phrases(spark):
    """One common phrase and one common passage among many documents, cut at places of all kinds."""
    local = np.random.default_rng(8)
    draw = lambda n: list(local.choice(VOCABULARY, n))
    passage = draw(40)
    texts = [draw(int(local.integers(0, 40))) + "as is known to everyone here".split() + (passage[int(local.integers(0, 9)) :] if i % 3 else []) + draw(int(local.integers(0, 30))) for i in range(120)]
    first = {}
    for i, w in enumerate(texts):
        for p in range(len(w) - 19):
            first.setdefault(tuple(w[p : p + 20]), (i, p))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(5)
    for r in substring_dedup(docs).collect():
        w = texts[r.doc_id]
        gone = {q for p in range(len(w) - 19) if first[tuple(w[p : p + 20])] < (r.doc_id, p) for q in range(p, p + 20)}
        assert r.kept_text == " ".join(x for i, x in enumerate(w) if i not in gone)


def test_suffix_dedup(docs, empty):
    assert suffix_dedup(empty).count() == 0
    count = Counter(b[p : p + 400] for r in docs.collect() for b in [(r.text or "").encode()] for p in range(len(b) - 399))
    for r in suffix_dedup(docs).collect():
        b = (r.text or "").encode()
        gone = {q for p in range(len(b) - 399) if count[b[p : p + 400]] > 1 for q in range(p, p + 400)}
        spans = sum(1 for i in gone if i - 1 not in gone)
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) == (len(b), len(gone), spans, bytes(x for i, x in enumerate(b) if i not in gone))


def test_suffix_dedup_of_hot_lines(spark):
    """One 70-byte line and one 500-byte passage in most documents, cut at places of all kinds."""
    local = np.random.default_rng(5)
    line, passage = "the same line stands in nearly every document of this collection, yes", "".join(local.choice(list("abcdefgh "), 500))
    draw = lambda n: "".join(local.choice(list("abcdefgh "), n))
    texts = [draw(int(local.integers(0, 500))) + line + (passage[int(local.integers(0, 60)) :] if i % 3 else "") + draw(int(local.integers(0, 300))) for i in range(90)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    count = Counter(t[p : p + 400] for t in texts for p in range(len(t) - 399))
    for r in suffix_dedup(docs).collect():
        t = texts[r.doc_id]
        gone = {q for p in range(len(t) - 399) if count[t[p : p + 400]] > 1 for q in range(p, p + 400)}
        assert (r.n_removed, bytes(r.kept_bytes).decode()) == (len(gone), "".join(x for i, x in enumerate(t) if i not in gone))


def test_reaches_against_all_pairs():
    local = np.random.default_rng(6)
    for _ in range(200):
        n = int(local.integers(2, 12))
        pairs = sorted((bytes(local.integers(97, 99, local.integers(0, 9)).astype(np.uint8)), bytes(local.integers(97, 99, local.integers(0, 9)).astype(np.uint8))) for _ in range(n))
        lcp = [0, *(shared(a[0], b[0]) for a, b in zip(pairs, pairs[1:], strict=False))]
        want = [[0, 0] for _ in range(n)]
        for i in range(n):
            for j in range(n):
                r, s = shared(pairs[i][0], pairs[j][0]), shared(pairs[i][1], pairs[j][1])
                if i != j and r + s >= 8:
                    want[i] = [max(want[i][0], s), max(want[i][1], r)]
        assert [list(x) for x in zip(*reaches([p[1] for p in pairs], lcp, 8), strict=True)] == want


def test_loser_tree_merges_front_coded_runs():
    every = [bytes(rng.integers(97, 99, rng.integers(0, 12)).astype(np.uint8)) for _ in range(400)]
    for k in (1, 2, 5, 7):
        runs = [sorted(every[i::k]) for i in range(k)]
        coded = []
        for r in runs:
            lcp, rest = front_code(r)
            assert front_decode(lcp.tolist(), [len(x) for x in r], b"".join(rest)) == r
            coded.append((r, lcp.tolist()))
        got = list(merge_runs(coded))
        merged = [runs[r][i] for r, i, _ in got]
        assert merged == sorted(every)
        assert all(n == shared(a, b) for a, b, (_, _, n) in zip(merged, merged[1:], got[1:], strict=False))


def shingles(t):
    w = words((t or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_jaccard_components(docs, empty):
    assert jaccard_components(empty).count() == 0
    rows = docs.collect()
    sets = [shingles(r.text) for r in rows]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root = [root[i] if x == root[j] else x for x in root]
    want = []
    for i, r in enumerate(rows):
        low = min((order(rows[j]) for j in range(len(rows)) if root[j] == root[i]), default=0)
        want.append((r.doc_id, len(sets[i]), None if low == -1 else low))
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    kept = near_duplicates_removed(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted({str(c) for _, _, c in want})


def test_long_words_that_a_polynomial_takes_for_equal(spark):
    """The Thue-Morse word of 2,048 letters and its complement, alone and inside shingles."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    a, b = ("".join("xy"[k ^ flip] for k in bits) for flip in (0, 1))
    near = prose(80)
    rows = [(1, a), (2, b), (3, a), (4, f"{near} {a}"), (5, f"{near} {b}"), (6, f"{a} b c d e"), (7, f"{b} b c d e")]
    got = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7}


def components_by_force(sets):
    root = np.arange(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[root == root[i]] = root[j]
    low = {}
    for i, r in enumerate(root.tolist()):
        low.setdefault(r, i)
    return [low[r] for r in root.tolist()]


def edits(seed, groups, size, rows):
    """Near copies of a few texts, most of them within reach of others."""
    local = np.random.default_rng(seed)
    base = [list(local.choice(VOCABULARY, size)) for _ in range(groups)]
    texts = []
    for _ in range(rows):
        w = list(base[local.integers(groups)])
        for _ in range(local.integers(0, 4)):
            w[local.integers(len(w))] = str(local.choice(VOCABULARY))
        texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("bits", [32, 3])
def test_large_regions_are_divided_across_tasks(spark, bits):
    texts = edits(4, 3, 60, 150) + edits(5, 1, 40, 60)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = jaccard_components(docs, cell=12, queries=8, bits=bits).collect()
    assert [r.component_id for r in sorted(got)] == components_by_force([shingles(t) for t in texts])


def test_near_duplicates_keep_unlinked_rows_of_one_id(spark):
    texts = [prose(40) for _ in range(5)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[0] + " tail"), (5, texts[2]), (5, texts[3]), (6, texts[3] + " tail"), (7, texts[4]), (8, ""), (None, ""), (None, None)]
    kept = near_duplicates_removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = Counter((r.doc_id, r.text if r.doc_id or not r.text else r.text.removesuffix(" tail")) for r in kept)
    assert got == Counter([(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (7, texts[4]), (8, ""), (None, ""), (None, None)])


def test_regions_recurse_exactly():
    base = rng.integers(0, 1 << 40, (6, 60))
    sets = []
    for _ in range(400):
        s = base[rng.integers(6)].copy()
        n = rng.integers(0, 12)
        s[rng.integers(0, 60, n)] = rng.integers(0, 1 << 40, n)
        sets.append(np.unique(s))
    region = Region(sets)
    region.join(np.arange(len(sets)))
    root = np.arange(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[root == root[i]] = root[j]
    assert len(np.unique(np.stack([root, region.root], 1), axis=0)) == len(np.unique(root)) == len(np.unique(region.root))


def test_fingerprints(docs, empty, spark):
    assert FP.fingerprint_documents(empty).count() == 0
    rows = sorted(docs.collect(), key=lambda r: (order(r), r.text or ""))
    want = []
    for r, s in zip(rows, rows[1:] + rows[:1], strict=True):
        t, n = r.text or "", s.text or ""
        h = len(t) // 2
        want.append((r.doc_id, len(t), t[: len(t) - h] + n[:h]))
    got = FP.fingerprint_documents(docs).collect()
    assert sorted(map(str, ((r.doc_id, r.n_chars, r.edited_text) for r in got))) == sorted(map(str, want))
    alike = {tuple(r.sketch) for r in got if r.doc_id in (0, 1, None)}
    assert len(alike) == 1 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    parts = spark.createDataFrame([(1, "a b c d e f g"), (1, "c d e f g h i")], "g int, t string").withColumn("s", FP.fingerprint(F.col("t")))
    assert len(FP.merged_fingerprints(parts, ["g"], "s").first().sketch) == 5


def test_small_fingerprints_hold_whole_sets(spark):
    """A sketch of fewer shingles than its size is the set itself, so likeness is exact."""
    local = np.random.default_rng(9)
    base = list(local.choice(VOCABULARY, 60))
    texts = []
    for _ in range(25):
        w = list(base)
        for _ in range(local.integers(0, 8)):
            w[local.integers(60)] = str(local.choice(VOCABULARY))
        texts.append(" ".join(w[: local.integers(3, 61)]))

    def sets(t):
        w = words(t)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    def like(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    got = {r.doc_id: r for r in FP.fingerprint_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        n = texts[(i + 1) % len(texts)]
        h = len(t) // 2
        assert abs(got[i].near_next - like(sets(t), sets(n))) < 1e-9
        assert abs(got[i].near_edited - like(sets(t), sets(t[: len(t) - h] + n[:h]))) < 1e-9
        assert len(got[i].sketch) == len(sets(t))


def test_pieces_join_to_the_ids_of_their_documents(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [prose(int(n)) + "" for n in rng.integers(1, 4000, 40)] + ["don't STOP 1,234 <|endoftext|> çà  \u00a0 x", ""]
    pieces = {}
    for r in pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), capacity=512).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    for i, text in enumerate(texts):
        own = sorted(pieces[i], key=lambda r: r.start)
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        assert b"".join(bytes(r.ids) for r in own) == ids.tobytes() and all(r.doc_tokens == len(ids) for r in own)


def test_held_out_documents(spark):
    """Predictions of rows that training never saw, on a small table."""
    from akshara.llm import queries as Q

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = Q.op7_language_id(spark, sf).join(docs, "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = Q.op9_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert sum(r.predicted == r.toxic for r in rows) >= 0.85 * len(rows) and sum(clean) <= 0.1 * len(clean)


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    import public_tokenizers

    assert pack_documents(empty).count() == 0
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = Counter(np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for r in docs.collect())
    out = pack_documents(docs).collect()
    for r in out:
        assert r.length * 4 == len(r.ids) and 0 < r.length <= 2048
    assert sum(r.length for r in out) == sum(len(k) // 4 * n for k, n in ids.items())
    short = Counter(bytes(r.ids) for r in out if r.length == r.doc_tokens)
    assert all(ids[k] >= n for k, n in short.items()) and zlib.crc32(b"") == 0
    levels = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == levels.get(r.sequence_id, 0)
        levels[r.sequence_id] = r.offset + r.length
    assert max(levels.values()) <= 2048 and sum(n < 2048 for n in levels.values()) <= 3


def test_levels_choose_the_smallest_sum_of_squares():
    levels = Levels(10)
    levels.count[:] = [0, 0, 3, 1, 0, 2, 0, 0, 0, 0, 0]
    for size in range(1, 10):
        def cost(level, size=size):
            n = levels.count.copy()
            if level:
                n[level] -= 1
            n[level + size] += level + size < 10
            return int((n[1:10] ** 2).sum())

        may = [0, *(k for k in range(1, 11 - size) if levels.count[k])]
        assert cost(levels.place(size)) == min(map(cost, may))


def test_decontamination(spark, empty):
    docs = spark.createDataFrame([(1, "Well then, John has 12 apples and gives Mary 5 of them after 3 hours of work , while Peter counts 12 coins. Yes"), (2, "nothing here of that sort"), (3, None), (4, "John has 12 apples and gives Mary 5 of them after 3 hours of work , while Peter counts 44 coins"), (5, f"so {PASSAGE} end"), (5, ""), (None, f"so {PASSAGE} end")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "Now , Anna has 30 apples and gives Bob 9 of them after 4 hours of work , while Carl counts 30 coins"), (8, "too short"), (9, None), (10, PASSAGE)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.changed_slots for r in contaminated(docs, items).collect()}
    assert got == {(1, 7): 6, (5, 10): 0, (None, 10): 0}
    left = decontaminate(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 5]
    assert contaminated(empty, items).count() == 0 and decontaminate(docs, items.limit(0)).count() == docs.count()


def test_decontamination_of_sentence_openings_and_whole_numbers(spark):
    items = [(1, "Anna has 30 apples. Bob eats 9. Carl buys 4 more. How many apples are left in total now?"), (2, "a truck of 1,200 crates went 2.5 miles and then 5 km to the port before noon")]
    texts = [(1, "John has 12 apples. Mary eats 5. Paul buys 3 more. How many apples are left in total now?"), (2, "so John has 12 apples. Mary eats 5. Paul buys 3 more. How many apples are left in total now?"), (3, "a truck of 900 crates went 7 miles and then 8km to the port before noon"), (4, "John runs 12 laps. Mary eats 5. Nobody buys more. How tall are trees in the park by now?")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 2)}


def test_decontamination_of_short_items_and_of_items_without_literal_words(spark):
    items = [(1, "who was he"), (2, "12 13 14 15 16 17 18 19 20 21"), (3, "Yes")]
    texts = [(1, "Who was he?"), (2, "and who was he then"), (3, "see 12 13 14 15 16 17 18 19 20 21 there"), (4, "see 1 2 3 4 5 6 7 8 9 10 there"), (5, "yes"), (6, "yes, of course")]
    found = contaminated(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 1), (3, 2), (5, 3)}


def test_url_filters(spark):
    rows = [(1, "http://A.Example.NET/de/x"), (2, "https://m.example.net/en/1?q"), (3, "https://b.example.com/de/1#t"), (4, "http://x.org/fr/"), (5, None), (6, "no scheme"), (7, "http://net"), (8, "http://notnet/"), (9, ""), (9, "http://x.org/fr/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1))
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else "") for r in filter_urls(pages).collect()), key=str)
    fr = (9, "x.org", "/fr/", "org/fr/", "allow")
    assert got == sorted([(1, "a.example.net", "/de/x", "net/", "block"), (2, "m.example.net", "/en/1", "example.net/en/", "allow"), (3, "b.example.com", "/de/1", "example.com/de/", "block"), (4, *fr[1:]), (5, "", "", None, ""), (6, "", "", None, ""), (7, "net", "", None, ""), (8, "notnet", "/", None, ""), (9, "", "", None, ""), fr], key=str)
    assert filter_urls(pages.limit(0)).count() == 0


def test_url_model_keeps_every_context_apart(spark):
    texts = ["http://x.org/fr/" + "".join(rng.choice(list(string.ascii_lowercase), 200)) if i % 2 else "http://y.net/" + "".join(rng.choice(list(string.ascii_uppercase), 200)) for i in range(2000)]
    texts += [None, "http://z.com/" + texts[0][13:], texts[1]]
    count, within = Counter(), Counter()
    for u in texts:
        side = {"x": 1, "y": 0}.get((u or "")[7:8])
        for p, c in enumerate(u or "") if side is not None else ():
            for k in range(6):
                context = (k, ("^" * k + u)[p : p + k])
                count[side, context, c] += 1
                within[side, context] += 1

    def ratio(u):
        total = [0.0, 0.0]
        for side in (0, 1):
            for p, c in enumerate(u):
                e = 1 / 256
                for k in range(6):
                    context = (k, ("^" * k + u)[p : p + k])
                    e = (count[side, context, c] + 4 * e) / (within[side, context] + 4)
                total[side] += np.log(e)
        return (total[1] - total[0]) / max(len(u), 1)

    pages = spark.createDataFrame(list(enumerate(texts)), "page_id long, url string")
    got = {r.page_id: r.ratio for r in filter_urls(pages).collect()}
    assert len(got) == len(texts)
    assert all(abs(got[i] - ratio(texts[i] or "")) < 1e-6 for i in [0, 1, 2, 3, *range(1990, len(texts))])


def test_warc_round_trip(spark):
    rows = [(1, "http://a/b c", "<p>é</p>"), (2, "u\r\nx", "<p>é</p>"), (3, None, None), (4, "v", ""), (None, "w", "<p>é</p>"), (5, "100%", "x" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = shared_folder(spark, "test-warc")
    assert write_warc(pages, folder, roll_bytes=500).agg(F.sum("records")).first()[0] == 6
    got = {r.id: r for r in read_warc(spark, folder).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), None: ("revisit", 2), 5: ("response", None)}
    for i, u, h in rows:
        b = (h or "").encode()
        assert (got[i].url, got[i].payload_bytes, got[i].payload_digest) == (u, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
    none = shared_folder(spark, "test-warc")
    write_warc(pages.limit(0), none)
    assert read_warc(spark, none).count() == 0


def test_network_gradients():
    net = Network(["a", "b", "c"], hidden=3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, y = rng.integers(97, 100, (7, 5)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    _, grad = net.gradients(x, y)
    for name in ("Ef", "Ub", "Cf", "V", "b"):
        at = tuple(rng.integers(s) if name[0] != "E" or i == 0 else 98 for i, s in enumerate(net.w[name].shape))
        old = net.w[name][at]
        net.w[name][at] = old + 1e-4
        up, _ = net.gradients(x, y)
        net.w[name][at] = old - 1e-4
        down, _ = net.gradients(x, y)
        net.w[name][at] = old
        assert abs((up - down) / 2e-4 - grad[name][at]) < 2e-3


def test_language(spark, docs, empty):
    rows = [(i, ("the thing with " if i % 2 else "über schön ") * (i % 7 + 1), "en" if i % 2 else "de") for i in range(60)]
    net = train_network(spark.createDataFrame(rows, "doc_id long, text string, lang string"), steps=40)
    got = predict_language(spark.createDataFrame([(1, "with the thing"), (2, "schön über"), (3, None), (4, ""), (5, "123 !")], "id int, text string"), net).collect()
    assert [r.lang_pred for r in sorted(got)] == ["en", "de", "und", "und", "und"] and all(0 <= r.score <= 1 for r in got)
    assert predict_language(docs, net).count() == docs.count() and predict_language(empty, net).count() == 0
    assert len(net.positions(b"the thing")) == 9


def test_toxicity(spark, docs, empty):
    rows = [(i, prose(30) + (" you grozzlebag fool " if i % 3 == 0 else " ") + prose(10), int(i % 3 == 0)) for i in range(120)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = train_toxicity(labelled.drop("toxic"), labelled.drop("text"))
    tests = [(1, prose(40) + " grozzlebag " + prose(40)), (2, prose(80)), (3, "GrozzLebag"), (4, "a gro-zzlebag here"), (5, ""), (6, None)]
    got = {r.id: r for r in score_toxicity(spark.createDataFrame(tests, "id int, text string"), machine).collect()}
    assert [got[i].predicted for i in (1, 2, 3, 5, 6)] == [1, 0, 1, 0, 0] and all(0 <= r.score <= 1 for r in got.values())
    assert score_toxicity(docs, machine).count() == docs.count() and score_toxicity(empty, machine).count() == 0
    assert score_toxicity(docs, train_toxicity(empty, labelled.drop("text").limit(0))).where("predicted = 1").count() == 0


def insults(near):
    """A machine trained on texts with one insult, its neighbours fixed or drawn, and a function that scores a text."""
    n = 120 if near else 240
    texts = [f"{prose(30)} {('you grozzlebag fool' if near else prose(2) + ' grozzlebag ' + prose(2)) if i % 3 == 0 else ''} {prose(10)}".encode() for i in range(n)]
    machine = train_machine(texts, np.array([int(i % 3 == 0) for i in range(n)]))
    return lambda t: machine.scores(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]


def test_inserted_characters_are_tolerated():
    score = insults(near=False)
    assert min(score(t) for t in ("a grozzlebag here", "a gro-zzlebag here", "a grozzl.ebag here")) >= 0.5 > max(score(prose(60)) for _ in range(20))


def test_inserted_characters_without_the_known_neighbours():
    assert insults(near=True)("a gro-zzlebag here") >= 0.5


ODD = "doc_id long, text string, lang string, source string, n_chars long, id int, label string, score double, predicted int, n_words int, n_removed int, kept_text string, `a.b` int, row string, key int"


def test_pipeline_stages_keep_columns_and_take_odd_rows(spark):
    import corpus_pipeline

    long = prose(60)
    texts = [None, "", " ", "one", long, long, long + " tail", prose(30) + " " + long, prose(4000), None]
    rows = [(None if i == 9 else i // 2, t, "en", None, len(t or ""), 7, "l", 77.0, 5, -1, -2, "k", 3, "r", 9) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, ODD).repartition(2)
    for data in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, data, "/root/testdata/sf0.001")
            assert out.columns == docs.columns, name
            for r in out.collect():
                assert (r.id, r.label, r.score, r.predicted, r.n_words, r.n_removed, r.kept_text, r["a.b"], r.row, r.key) == (7, "l", 77.0, 5, -1, -2, "k", 3, "r", 9), name
            if data is docs:
                n = {"toxicity": 10, "near_duplicates": 8, "repeated_windows": 10, "benchmark_leaks": 10}[name]
                assert out.count() == n, name
        pieces = corpus_pipeline.STAGES[4][1](spark, data, "").collect()
        assert sum(p.start == 0 for p in pieces) == (10 if data is docs else 0)


def test_operators_take_clashing_names(spark):
    rows = [(i, t, "en", "s", len(t), 7, "l", 77.0, 5, -1, -2, "k", 3, "r", 9) for i, t in enumerate([prose(40), prose(40), "", "http://a.b/c"])]
    docs = spark.createDataFrame(rows, ODD)
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")
    assert FP.fingerprint_documents(docs).count() == suffix_dedup(docs).count() == jaccard_components(docs).count() == 4
    assert pack_documents(docs).select("doc_id").distinct().count() == 4
    assert predict_language(docs, train_network(docs, steps=2)).count() == score_toxicity(docs, train_toxicity(docs, labels)).count() == 4
    pages = docs.withColumn("page_id", F.col("doc_id")).withColumn("url", F.col("text")).withColumn("html", F.col("text"))
    folder = shared_folder(spark, "test-warc")
    write_warc(pages, folder)
    assert filter_urls(pages).count() == read_warc(spark, folder).count() == 4


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 50 and "sequence_id" in out.columns


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op6_jaccard_join", "op8_warc", "op10_suffix_dedup"])
def test_against_sql(spark, name):
    import duckdb

    from akshara.llm import queries as Q

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = db.sql(Q.oracle_sql()[name])
    got = Q.queries()[name](spark, sf).select(*[F.col(c) for c in want.columns])
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
