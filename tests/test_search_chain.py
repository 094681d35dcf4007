"""Searches judged all at once against a run that goes hit by hit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from akshara.functions import text as X
from akshara.operators import articles as A
from akshara.operators import crawl as C

HIT = "ord long, query string, engine string, url string, title string, date string, source string, listing_url string"
PAGE = "url string, body string, real_url string, page_date string, extractor string, page_title string"
WINDOW = ("2024-01-24", "2024-01-30")
BODY = "Railway platform work starts and the train timetable changes for passengers on the line. " * 5
HITS = [
    (0, "rail", "brave", "https://www.msn.com/a", "Railway work starts", "2024-01-28", "msn"),
    (1, "rail", "brave", "https://a.com/1?utm_source=x", "Railway work starts", "2024-01-28", "a"),
    (2, "rail", "bing", "http://www.a.com/1/", "Railway work starts", "", "a"),
    (3, "rail", "bing", "https://b.com/2", "Railway work starts", "", "b"),
    (4, "rail", "bing", "https://c.com/3", "Old railway story", "2023-01-01", "c"),
    (5, "rail", "bing", "https://d.com/4", "Railway bridge opens", "", "d"),
    (6, "train", "brave", "https://e.com/5", "Cricket results", "2024-01-29", "e"),
    (7, "train", "brave", "https://f.com/6", "A long railway title that...", "", "f"),
    (8, "train", "bing", "https://g.com/7", "Railway freight grows", "2024-01-29", "g"),
    (9, "train", "bing", "https://h.com/8", "Railway fares change", "", "h"),
    (10, "train", "bing", "https://i.com/9", "Railway staff meet", "", "i"),
    (11, "train", "bing", "https://c.com/3", "Old railway story", "2024-01-29", "c"),
]
PAGES = [
    ("https://a.com/1?utm_source=x", BODY, "2024-01-28", ""),
    ("https://b.com/2", BODY, "2024-01-28", ""),
    ("https://c.com/3", BODY, "2024-01-28", ""),
    ("https://d.com/4", "short", "2024-01-28", ""),
    ("https://e.com/5", "Cricket match and the score of the players. " * 10, "2024-01-29", ""),
    ("https://f.com/6", BODY, "2024-01-29", "A long railway title that ends here"),
    ("https://g.com/7", BODY, "2023-12-01", ""),
    ("https://h.com/8", BODY, "", ""),
    ("https://i.com/9", BODY, "2024-01-30", ""),
]




def fixture(spark, **options):
    hits = spark.createDataFrame([(*h, "") for h in HITS], HIT)
    pages = spark.createDataFrame([(u, b, u, d, "generic", t) for u, b, d, t in PAGES], PAGE)
    return C.search_chain(hits, pages, WINDOW, **options)


def test_reasons_of_a_search(spark):
    got = {r.ord: (r.title, r.date, r.reason, r.body is not None) for r in fixture(spark).collect()}
    assert got == {
        0: ("Railway work starts", "2024-01-28", "aggregator or social site", False),
        1: ("Railway work starts", "2024-01-28", "kept", True),
        2: ("Railway work starts", "", "already have this URL", False),
        3: ("Railway work starts", "2024-01-28", "already have this story", False),
        4: ("Old railway story", "2024-01-28", "outside the date window", False),
        5: ("Railway bridge opens", "2024-01-28", "body too short", False),
        6: ("Cricket results", "2024-01-29", "off-topic", False),
        7: ("A long railway title that ends here", "2024-01-29", "kept", True),
        8: ("Railway freight grows", "2023-12-01", "outside the date window", False),
        9: ("Railway fares change", "", "kept", True),
        10: ("Railway staff meet", "2024-01-30", "kept", True),
        11: ("Old railway story", "2024-01-28", "already have this URL", False),
    }
    by = {r.engine: (r.kept, r.publishers) for r in C.kept_by_engine(fixture(spark)).collect()}
    assert by == {"brave": (2, 2), "bing": (2, 2)}


def test_caps_of_a_search(spark):
    got = {r.ord: r.reason for r in fixture(spark, cap=1, keep_undated=False, keywords=["railway"], mode="only").collect()}
    assert {k: got[k] for k in (1, 2, 3, 6, 7, 8, 9, 10, 11)} == {1: "kept", 2: "beyond the cap", 3: "beyond the cap", 6: "off-topic", 7: "kept", 8: "beyond the cap", 9: "beyond the cap", 10: "beyond the cap", 11: "beyond the cap"}


def hit_by_hit(facts, cap):
    """facts in order; what a run would say."""
    urls, titles, kept, out = set(), set(), {}, {}
    for f in facts:
        if cap is not None and kept.get(f.query, 0) >= cap:
            out[f.ord] = "beyond the cap"
        elif f.blocked:
            out[f.ord] = "aggregator or social site"
        elif f.key in urls:
            out[f.ord] = "already have this URL"
        else:
            urls.add(f.key)
            if f.hit_key and f.hit_key in titles:
                out[f.ord] = "already have this story"
            elif f.old:
                out[f.ord] = "outside the date window"
            else:
                urls.add(f.real_key)
                if f.later:
                    out[f.ord] = f.later
                elif f.title_key and f.title_key in titles:
                    out[f.ord] = "already have this story"
                else:
                    titles.add(f.title_key)
                    kept[f.query] = kept.get(f.query, 0) + 1
                    out[f.ord] = "kept"
    return out


@pytest.mark.parametrize("seed,cap", [(1, None), (2, 1), (3, 3), (4, 2)])
def test_against_a_run_hit_by_hit(spark, seed, cap):
    """Few addresses and titles, so that hits repeat, redirect and take one another's titles across queries."""
    rng = np.random.default_rng(seed)
    hosts = [f"http://h{i}.com/a" for i in range(60)] + ["https://www.msn.com/x"]
    words = [f"railway story {w}" for w in ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "a", "b", "c", "d")]
    title = lambda: str(rng.choice([*words, "railway stor...", ""]))
    hits = []
    for q in range(8):
        for k in range(30):
            hits.append((q * 100 + k, f"q{q}", ["brave", "bing"][k // 15], str(rng.choice(hosts)) + ["", "/", "#x"][rng.integers(3)], title(), ["", "2024-01-28", "2023-01-01"][rng.choice(3, p=[0.45, 0.45, 0.1])], "s", ""))
    urls = sorted({h[3] for h in hits})
    pages = [(u, BODY if rng.random() < 0.9 else "short", str(rng.choice(hosts[:60])) if rng.random() < 0.3 else u, ["", "2024-01-29", "2023-01-01"][rng.choice(3, p=[0.3, 0.6, 0.1])], "generic", str(rng.choice(words))) for u in urls]
    hits, pages = spark.createDataFrame(hits, HIT).repartition(3), spark.createDataFrame(pages, PAGE)
    facts = C.search_facts(hits, pages, WINDOW, None, "narrow", True, 300, C.L.STRONG, C.L.WEAK).orderBy("ord").collect()
    got = {r.ord: r.reason for r in C.search_chain(hits, pages, WINDOW, cap=cap).collect()}
    want = hit_by_hit(facts, cap)
    assert got == want
    assert len({*want.values()}) >= 5


def test_no_hits(spark):
    assert C.search_chain(spark.createDataFrame([], HIT), spark.createDataFrame([], PAGE), WINDOW, cap=1).count() == 0


def test_keywords_are_normalised_as_texts_are(spark):
    """A keyword with a composed nukta or a zero-width joiner finds the text of either form."""
    forms = ["\u095c", "\u0921\u093c"]
    rows = [(i, f"रेलगा{x}ी आई") for i, x in enumerate(forms)]
    df = A.with_tokens(spark.createDataFrame(rows, "id int, text string"), F.col("text"))
    for keyword in [f"रेलगा{x}ी" for x in forms] + ["रेल\u200dगा\u0921\u093cी", f"रेलगा{forms[0]}ी  आई"]:
        assert [r.hit for r in df.select("id", C.matches_keywords([keyword]).alias("hit")).orderBy("id").collect()] == [True, True], keyword
    assert X.normal_term(" A\u200b \u095c  b ") == "a \u0921\u093c b"
