"""Term lists as expressions and as tables, and titles in classes."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from akshara.functions import lexicon as L
from akshara.functions import text as X
from akshara.operators import articles as A
from akshara.operators import lexicon as LX

TERMS = ["रेल", "गाड़ी", "ट्रेन", "ट्रेनों", "वंदे भारत", "rail", "railway", "new line", "a b", "on the", "e o"]
TEXTS = [None, "", "Railway RAIL rails", "नई ट्रेनों की सूची, रेलगाड़ियों और गाड़ियाँ", "वंदे  भारत का उद्घाटन", "the new\tline on the​re", "a  b", "some one", "x" * 10]


def found_by_hand(text):
    """What term_hits() gave one expression a term."""
    blob = X.normal_term(text or "")
    import re

    words = {*re.findall("[ऀ-ॿ]{2,}", blob), *re.findall("[a-z]{3,}", blob)}
    stems = {X.stem_of(w) if w >= "ऀ" else w for w in words}
    return [t for t in map(X.normal_term, TERMS) if (t in blob if " " in t else t in words or X.stem_of(t) in stems)]


def test_term_hits_in_the_order_of_the_list(spark):
    rows = A.with_tokens(spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string"), F.col("text"))
    terms = [X.normal_term(t) for t in TERMS]
    got = {r.id: r.hits for r in rows.select("id", X.term_hits(terms, F.col("blob"), F.col("words"), F.col("stems")).alias("hits")).collect()}
    assert got == {i: found_by_hand(t) for i, t in enumerate(TEXTS)}
    assert sum(map(len, got.values())) > 8
    assert [r.h for r in rows.select(X.term_hits([], F.col("blob"), F.col("words"), F.col("stems")).alias("h")).distinct().collect()] == [[]]


def test_lexicon_tables_find_what_expressions_find(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    lexicon = spark.createDataFrame([("l", t) for t in TERMS] + [("l", ""), ("m", "RAIL"), ("m", None)], "list string, term string")
    got = {(r.idx, r.list, r.term) for r in LX.lexicon_hits(docs, "id", F.col("text"), lexicon).collect()}
    want = {(i, "l", t) for i, text in enumerate(TEXTS) for t in found_by_hand(text)}
    assert {g for g in got if g[1] == "l"} == want
    assert {g for g in got if g[1] == "m"} == {(2, "m", "rail")}
    assert LX.lexicon_hits(docs, "id", F.col("text"), lexicon.limit(0)).count() == 0


def test_long_lists(spark):
    """Ten thousand terms: each text finds its own."""
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    terms = sorted({word() for _ in range(5000)} | {f"{word()} {word()}" for _ in range(5000)})
    texts = [" ".join(rng.choice(terms, 30)) for _ in range(40)]
    lexicon = spark.createDataFrame([("l", t) for t in terms], "list string, term string")
    got: dict[int, set] = {}
    for r in LX.lexicon_hits(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", F.col("text"), lexicon).collect():
        got.setdefault(r.idx, set()).add(r.term)
    assert got == {i: {t for t in terms if (t in x if " " in t else t in x.split())} for i, x in enumerate(texts)}


@pytest.mark.parametrize("text", ["a   b", " x　", "a\x0b\x0c\r\n  b", " é  è ", "­​", "ऩड़  x", "\x85 a", "a      b       c                 d"])
def test_white_space_of_every_kind(spark, text):
    import re
    import unicodedata

    want = re.sub(r"[ \t\n\x0b\x0c\r   -     　]+", " ", unicodedata.normalize("NFC", text.translate(dict.fromkeys(map(ord, L.ZERO_WIDTH))))).strip(" ")
    assert spark.createDataFrame([(text,)], "t string").select(X.normalized(F.col("t")).alias("x"), X.normalized(F.col("t"), full=True).alias("y")).first() == (want, want)


def test_equal_titles_cost_no_pairs(spark):
    """A wire title of 20,000 articles is one class, linked with its likes by one edge a class."""
    rows = spark.range(20_000).select(F.col("id").alias("i"), F.lit("railway bridge opens after long works").alias("t"))
    more = spark.createDataFrame([(20_000, "railway bridge opens after works"), (20_001, "cricket team wins match"), (20_002, ""), (20_003, "cricket team wins great match")], "i long, t string")
    df = rows.unionByName(more).withColumn("w", X.title_words(F.col("t")))
    began = time.time()
    members, classes = A.title_classes(df, "i", "w")
    assert classes.count() == 4 and members.count() == 20_003 and A.story_edges(classes, 0.2).count() == 2
    sizes = {r.cluster: r.n for r in A.story_components(df, "i", "w", 0.2).groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    assert sizes == {0: 20_001, 20_001: 2, 20_002: 1}
    near = A.same_story(df, "i", "w", 0.45, 3)
    assert near.count() == 3 * 20_001 + 2
    assert [(r.others, r.place, r.other, r.score) for r in near.where("i = 1").orderBy("place").collect()] == [(20_000, 0, 0, 1.0), (20_000, 1, 2, 1.0), (20_000, 2, 3, 1.0)]
    assert [(r.others, r.other) for r in near.where("i = 20000").orderBy("place").collect()] == [(20_000, 0), (20_000, 1), (20_000, 2)]
    assert [(r.others, r.place, r.other, r.score) for r in near.where("i = 20001").collect()] == [(1, 0, 20_003, 0.8)]
    assert time.time() - began < 120


@pytest.mark.parametrize("threshold", [0.2, 0.45, 0.8])
def test_links_of_classes_leave_the_components_of_all_pairs(spark, threshold):
    rng = random.Random(threshold)
    sets = [rng.sample(range(40 if i % 2 else 400), rng.choice((1, 2, 3, 5, 8, 12))) for i in range(300)]
    sets += [[900 + x for x in range(12) if x != i] + [1000 + i] for i in range(12)]
    df = spark.createDataFrame([(i, [f"w{x}" for x in s]) for i, s in enumerate(sets)], "i long, w array<string>")
    root = list(range(len(sets)))

    def of(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(set(a) & set(sets[j]))
            if n and n >= threshold * (len(a) + len(sets[j]) - n):
                x, y = sorted((of(i), of(j)))
                root[y] = x
    assert {r.node: r.cluster for r in A.story_components(df, "i", "w", threshold).collect()} == {i: of(i) for i in range(len(sets))}


def test_a_frequent_word_costs_no_pairs(spark):
    """2,000 titles of a common word and one of their own are 2 million pairs that link."""
    df = spark.range(2_000).select(F.col("id").alias("i"), F.array(F.lit("railway"), F.concat(F.lit("w"), F.col("id").cast("string"))).alias("w"))
    links = A.story_links(A.title_classes(df, "i", "w")[1], 0.2)
    assert links.count() == 1_999
    assert A.story_components(df, "i", "w", 0.2).where("cluster = 0").count() == 2_000


def test_pairs_of_likely_titles_are_all_found_and_few_are_looked_at(spark, monkeypatch):
    """Titles of four words of a small stock share single words by the thousand; only those of enough common words meet."""
    rng = random.Random(6)
    sets = [frozenset(rng.sample(range(25), 4)) for _ in range(600)] + [frozenset(rng.sample(range(25), n)) for n in (1, 2, 3, 5, 7, 9) for _ in range(20)]
    sets = list(dict.fromkeys(sets))
    classes = A.title_classes(spark.createDataFrame([(i, [f"w{x}" for x in s]) for i, s in enumerate(sets)], "i long, w array<string>"), "i", "w")[1]
    for threshold in (0.2, 0.45, 0.8):
        want = {(i, j): len(a & sets[j]) / len(a | sets[j]) for i, a in enumerate(sets) for j in range(i + 1, len(sets))}
        want = {p: v for p, v in want.items() if v and v >= threshold}
        found = A.story_edges(classes, threshold)
        assert {(r.a, r.b): r.score for r in found.collect()} == want
    met = [held.count() for k, held in A.shared_subsets(A.ranked_sets(classes, 0.8), 0.8) if k == 1]
    assert met[0] < 4 * len(sets)


def test_a_word_is_looked_up_once(spark, monkeypatch):
    """By its stem alone; each token was looked up a second time as itself."""
    asked, keys = [], LX.text_keys
    monkeypatch.setattr(LX, "text_keys", lambda words, stems, blob, kinds: asked.extend(kinds) or keys(words, stems, blob, kinds))
    lexicon = spark.createDataFrame([("l", "ट्रेन"), ("l", "rail")], "list string, term string")
    found = LX.lexicon_hits(spark.createDataFrame([(1, "नई ट्रेनों rail"), (2, "rails")], "id int, text string"), "id", F.col("text"), lexicon)
    assert sorted((r.idx, r.term) for r in found.collect()) == [(1, "rail"), (1, "ट्रेन")] and asked == ["stem"]
