"""Queries of crawl chains, clusters, scoring and review over fixtures and the test tables.

A fixture's SQL twin is the list of rows that the rules give, written out; a
table's twin works them out.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from akshara.functions import text as X
from akshara.operators import articles as A
from akshara.operators import crawl as C
from akshara.operators import review as R
from akshara.operators import stories as T
from akshara.plans import queries as Q
from akshara.plans import review as V
from akshara.sources import pages as P
from akshara.sources import search as S
from akshara.streaming import articles as ST

SQL: dict[str, str] = {}


def literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    return str(x) if isinstance(x, int | float) else "'" + x.replace("'", "''") + "'"


def expected(columns: str, *rows: tuple) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) v({columns})"


def keyword_filters(spark, sf_dir):
    """Articles whose title or first 600 characters hold one of two keywords, in both modes."""
    rows = A.with_tokens(Q.articles(spark, sf_dir), F.concat_ws(" ", "title", F.left("body", F.lit(600))))
    words = C.keyword_list("apple, and the\n")
    gate = lambda mode: C.passes_topic(words, mode, Q.STRONG, Q.WEAK)
    return rows.select("doc_id", gate("only").alias("only"), gate("narrow").alias("narrow"), C.passes_topic([], "narrow", Q.STRONG, Q.WEAK).alias("subject"))


SQL["keyword_filters"] = f"""WITH {Q.token_sql(Q.ART, "title || ' ' || left(body, 600)")}, k AS (SELECT doc_id, blob <> '' AND len({Q.hits_sql(("apple", "and the"))}) > 0 AS m, len({Q.hits_sql(Q.STRONG)}) > 0 OR len({Q.hits_sql(Q.WEAK)}) >= 2 AS s FROM t3) SELECT doc_id, m AS only, m AND s AS narrow, s AS subject FROM k"""

KEYWORD_TEXTS = [(1, "रेलगाड़ियों का आंशिक रद्दीकरण"), (2, "प्रशिक्षण ट्रेनिंग कार्यक्रम आयोजित"), (3, "वंदे भारत का उद्घाटन"), (4, ""), (5, "नई ट्रेनों की सूची")]


def keyword_cases(spark, sf_dir):
    """Inflected keywords, a phrase, and a word inside another."""
    rows = A.with_tokens(spark.createDataFrame(KEYWORD_TEXTS, "id int, text string"), F.col("text"))
    hit = {"car": ["रेलगाड़ी"], "train": ["ट्रेन"], "phrase": ["वंदे भारत"], "none": []}
    return rows.select("id", *[C.matches_keywords(k).alias(n) for n, k in hit.items()])


SQL["keyword_cases"] = expected("id, car, train, phrase, none", (1, True, False, False, True), (2, False, False, False, True), (3, False, False, True, True), (4, False, False, False, True), (5, False, True, False, True))


def keyword_terms(spark, sf_dir):
    rows = spark.createDataFrame([(1, "a, वंदे भारत ,,b\nc"), (2, ""), (3, None), (4, " , \n")], "id int, raw string")
    return rows.select("id", F.array_join(C.parse_keywords(F.col("raw")), "|").alias("terms"))


SQL["keyword_terms"] = expected("id, terms", (1, "a|वंदे भारत|b|c"), (2, ""), (3, ""), (4, ""))

TODAY = datetime.date(2024, 1, 30)
WINDOWS = {"range": dict(first="2024-01-05", last="2024-01-06"), "from": dict(first="2024-01-20", days=2), "open": dict(days=0), "last3": dict(days=3), "default": {}}


def run_windows(spark, sf_dir):
    """Events in the windows of five runs: an explicit range before days, 0 for open, else the last days, else the default; undated rows kept or not."""
    rows = Q.date_window(spark, sf_dir).select("event_id", "published")
    out = []
    for name, args in WINDOWS.items():
        d = C.dated(rows, "published", C.run_window(TODAY, **args), keep_undated=name != "last3")
        out.append(d.groupBy(F.lit(name).alias("run")).agg(F.count_if("kept").alias("kept"), F.count_if(F.col("verdict") == "too_old").alias("too_old"), F.count_if(F.col("verdict") == "undated").alias("undated")))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).unionByName(out[4])


_windows = {"range": "day BETWEEN DATE '2024-01-05' AND DATE '2024-01-06'", "from": "day >= DATE '2024-01-20'", "open": "true", "last3": "day BETWEEN DATE '2024-01-28' AND DATE '2024-01-30'", "default": "day BETWEEN DATE '2024-01-24' AND DATE '2024-01-30'"}
SQL["run_windows"] = f"WITH d AS (SELECT {Q._published} AS published, CASE WHEN event_id % 9 < 8 THEN CAST(ts AS DATE) END AS day FROM events) " + " UNION ALL ".join(
    f"SELECT '{n}' AS run, count(*) FILTER ({w}{'' if n == 'last3' else ' OR day IS NULL'}) AS kept, count(*) FILTER (day IS NOT NULL AND NOT ({w})) AS too_old, {0 if n == 'open' else 'count(*) FILTER (day IS NULL)'} AS undated FROM d" for n, w in _windows.items()
)

#: Days that page_hits() dates pages by, and the window that searches keep.
PUBLISHED = ("2024-01-05", "2024-01-22")


def page_hits(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Hits of five queries on two engines, and the pages they lead to, drawn from pages: each page is found twice, some by another address that leads to its own, with a cut title, on a blocked host, or without a date."""
    pages = Q.table(spark, sf_dir, "pages")
    parts = F.filter(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit("<p[^>]*>([^<]*)"), F.lit(1)), lambda p: F.trim(F.regexp_replace(p, X.WHITE, " "))), lambda p: F.length(p) >= 30)
    rows = pages.select("page_id", "url", F.regexp_extract(F.coalesce("html", F.lit("")), "<h1[^>]*>([^<]*)", 1).alias("page_title"), F.array_join(parts, "\n\n").alias("body"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    i, k = F.col("page_id"), F.col("k")
    found = F.when(i % 17 == 0, F.concat(F.lit("https://www.msn.com/"), i.cast("string"))).when((k == 1) & (i % 3 == 0), F.concat(F.lit("http://alt.example/"), (i % 40).cast("string"))).when((k == 1) & (i % 3 == 1), F.concat("url", F.lit("#found")))
    day = F.format_string("2024-01-%02d", i % 28 + 1)
    query = (i * (3 + 4 * k) + k) % 5
    engine = (i + k) % 2
    title = F.when(i % 7 == 0, F.concat(F.left("page_title", F.lit(12)), F.lit("..."))).otherwise(F.col("page_title"))
    rows = rows.select(((query * 2 + engine) * 10_000_000_000 + i * 2 + k).alias("ord"), F.concat(F.lit("q"), query.cast("string")).alias("query"), F.when(engine == 0, "brave").otherwise("bing").alias("engine"), F.coalesce(found, "url").alias("url"), title.alias("title"), F.when(i % 4 != 0, day).otherwise("").alias("date"), F.concat(F.lit("s"), (i % 9).cast("string")).alias("source"), F.lit("").alias("listing_url"), "body", F.col("url").alias("real_url"), F.when((i + k) % 5 != 0, day).otherwise("").alias("page_date"), F.lit("generic").alias("extractor"), "page_title", (i * 2 + k).alias("place"))
    # what an address shows is what its first page in the order of ids shows
    first = rows.groupBy("url").agg(F.min_by(F.struct("body", "real_url", "page_date", "extractor", "page_title"), "place").alias("p"))
    return rows.select("ord", "query", "engine", "url", "title", "date", "source", "listing_url"), first.select("url", "p.*")


def searched(spark, sf_dir, **options) -> DataFrame:
    return C.search_chain(*page_hits(spark, sf_dir), PUBLISHED, strong=Q.STRONG, weak=Q.WEAK, **options)


def search_chain(spark, sf_dir):
    """What becomes of every hit of a keyword search."""
    return searched(spark, sf_dir).select("ord", "title", "date", "link", F.md5("body").alias("body_md5"), "reason", "undated")


_par = Q._par.replace("html", "coalesce(html, '')")
_hits = rf"""k AS (SELECT page_id AS i, url AS own, regexp_extract(coalesce(html, ''), '<h1[^>]*>([^<]*)', 1) AS page_title, array_to_string({_par}, chr(10) || chr(10)) AS body, unnest([0, 1]) AS k FROM pages),
h0 AS (SELECT *, (i * (3 + 4 * k) + k) % 5 AS q, (i + k) % 2 AS e, '2024-01-' || lpad(CAST(i % 28 + 1 AS VARCHAR), 2, '0') AS day, CASE WHEN i % 17 = 0 THEN 'https://www.msn.com/' || i WHEN k = 1 AND i % 3 = 0 THEN 'http://alt.example/' || (i % 40) WHEN k = 1 AND i % 3 = 1 THEN own || '#found' ELSE own END AS url FROM k),
h1 AS (SELECT (q * 2 + e) * 10000000000 + i * 2 + k AS ord, 'q' || q AS query, CASE e WHEN 0 THEN 'brave' ELSE 'bing' END AS engine, url, CASE WHEN i % 7 = 0 THEN left(page_title, 12) || '...' ELSE page_title END AS title, CASE WHEN i % 4 <> 0 THEN day ELSE '' END AS date, 's' || (i % 9) AS source, i, k, body, own AS real_url, CASE WHEN (i + k) % 5 <> 0 THEN day ELSE '' END AS page_date, page_title FROM h0),
f AS (SELECT url, body, real_url, page_date, page_title FROM h1 QUALIFY row_number() OVER (PARTITION BY url ORDER BY i, k) = 1),
h2 AS (SELECT h.ord, h.query, h.engine, h.url, h.title AS hit_title, h.date AS hit_date, h.source, f.body, f.real_url, CASE WHEN h.title = '' OR ends_with(h.title, '...') OR ends_with(h.title, '…') THEN f.page_title ELSE h.title END AS title, CASE WHEN f.page_date <> '' THEN f.page_date ELSE h.date END AS date FROM h1 h JOIN f USING (url))"""


def _url(x: str) -> str:
    rest = f"regexp_replace(regexp_replace({x}, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
    query = rf"list_sort(list_filter(string_split(regexp_extract({rest}, '^[^?]*\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_')))"
    return rf"regexp_replace(lower(regexp_extract({rest}, '^([^/?]*)', 1)), '^www\.', '') || regexp_replace(regexp_replace(regexp_extract({rest}, '^[^/?]*([^?]*)', 1), ';[^/]*$', ''), '/+$', '') || CASE WHEN len({query}) > 0 THEN '?' || array_to_string({query}, '&') ELSE '' END"


def searched_sql(topic: str, cap: int | None, keep_undated: bool) -> str:
    """The run hit by hit: seen addresses, kept titles and the queries of kept hits as lists."""
    outside = "(date <> '' AND date NOT BETWEEN '2024-01-05' AND '2024-01-22')"
    undated = "" if keep_undated else "WHEN date = '' THEN 'no date on page'"
    full = f"len(list_filter(s.takers, lambda t: t = n.query)) >= {cap}" if cap else "false"
    return rf"""{_hits}, {Q.token_sql("SELECT * FROM h2", "title || ' ' || left(body, 600)")},
n AS (SELECT row_number() OVER (ORDER BY ord) AS n, ord, query, engine, source, title, date, url, real_url, body, {_url("url")} AS key, {_url("real_url")} AS real_key, {Q.key("hit_title")} AS hit_key, {Q.key("title")} AS title_key, contains(url, '//www.msn.com/') AS blocked, hit_date <> '' AND hit_date NOT BETWEEN '2024-01-05' AND '2024-01-22' AS old, CASE WHEN length(body) < 300 THEN 'body too short' WHEN NOT ({topic}) THEN 'off-topic' {undated} WHEN {outside} THEN 'outside the date window' END AS later FROM t3),
s AS (SELECT 0::BIGINT AS n, ''::VARCHAR AS reason, []::VARCHAR[] AS urls, []::VARCHAR[] AS titles, []::VARCHAR[] AS takers
UNION ALL SELECT n, reason, CASE WHEN reason IN ('beyond the cap', 'aggregator or social site') THEN urls WHEN reason = 'already have this URL' OR early THEN list_append(urls, key) ELSE list_concat(urls, [key, real_key]) END, CASE WHEN reason = 'kept' AND title_key <> '' THEN list_append(titles, title_key) ELSE titles END, CASE WHEN reason = 'kept' THEN list_append(takers, query) ELSE takers END
FROM (SELECT n.n, n.query, n.key, n.real_key, n.title_key, s.urls, s.titles, s.takers, (n.hit_key <> '' AND list_contains(s.titles, n.hit_key)) OR n.old AS early, CASE WHEN {full} THEN 'beyond the cap' WHEN n.blocked THEN 'aggregator or social site' WHEN list_contains(s.urls, n.key) THEN 'already have this URL' WHEN n.hit_key <> '' AND list_contains(s.titles, n.hit_key) THEN 'already have this story' WHEN n.old THEN 'outside the date window' WHEN n.later IS NOT NULL THEN n.later WHEN n.title_key <> '' AND list_contains(s.titles, n.title_key) THEN 'already have this story' ELSE 'kept' END AS reason FROM s JOIN n ON n.n = s.n + 1)),
r AS (SELECT n.*, s.reason FROM n JOIN s USING (n))"""


_subject = f"len({Q.hits_sql(Q.STRONG)}) > 0 OR len({Q.hits_sql(Q.WEAK)}) >= 2"
_search = "WITH RECURSIVE " + searched_sql(_subject, None, True)
SQL["search_chain"] = f"{_search} SELECT ord, title, date, real_url AS link, CASE WHEN reason = 'kept' THEN md5(body) END AS body_md5, reason, date = '' AS undated FROM r"


def search_caps(spark, sf_dir):
    """The same hits with a cap of four per query, undated pages dropped and two keywords in mode only."""
    return searched(spark, sf_dir, cap=4, keep_undated=False, keywords=["apple", "the"], mode="only").select("ord", "query", "reason")


SQL["search_caps"] = "WITH RECURSIVE " + searched_sql(f"blob <> '' AND len({Q.hits_sql(('apple', 'the'))}) > 0", 4, False) + " SELECT ord, query, reason FROM r"


def kept_by_engine(spark, sf_dir):
    """Articles and publishers of each engine with a cap of nine per query."""
    return C.kept_by_engine(searched(spark, sf_dir, cap=9))


SQL["kept_by_engine"] = "WITH RECURSIVE " + searched_sql(_subject, 9, True) + " SELECT engine, count(*) FILTER (reason = 'kept') AS kept, count(DISTINCT CASE WHEN reason = 'kept' THEN source END) AS publishers FROM r GROUP BY engine"

BODY = "Railway platform work starts and the train timetable changes for passengers on the line. " * 5
HINDI = "रेल मंत्रालय ने नई गाड़ी की घोषणा की और यात्रियों को सुविधा मिलेगी। " * 5
RELEASES = [
    (0, "CR", "Central Railway", "नई ट्रेन का शुभारंभ", "28-01-2024", "u0", HINDI),
    (1, "CR", "Central Railway", "नई ट्रेन का शुभारंभ", "27-01-2024", "u1", HINDI),
    (2, "WR", "Western Railway", "नई ट्रेन का शुभारंभ", "26-01-2024", "u2", HINDI),
    (3, "NR", "Northern Railway", "रेल समाचार", "29-01-2024", "u3", BODY),
    (4, "NR", "Northern Railway", "पुराना समाचार", "01-01-2024", "u4", HINDI),
    (5, "NR", "Northern Railway", "बिना तारीख", "", "u5", HINDI),
    (6, "ER", "Eastern Railway", "खाली पृष्ठ", "29-01-2024", "u6", "Add Hindi content here"),
    (7, "ER", "Eastern Railway", "संलग्न", "29-01-2024", "u7", "x [PDF attached: x]"),
    (8, "ER", "Eastern Railway", "छोटा", "29-01-2024", "u8", "बहुत छोटा"),
]


def releases(spark) -> DataFrame:
    return spark.createDataFrame(RELEASES, "ord int, zone_code string, zone_name string, title string, date string, link string, body string")


def release_chain(spark, sf_dir):
    """Press releases of zones in a window: repeats count per zone, thin bodies by kind, and English bodies go."""
    out = C.release_chain(releases(spark), C.last_days(7, TODAY), hindi_only=True)
    return out.select("ord", "reason", "is_hindi_body", "source")


SQL["release_chain"] = expected(
    "ord, reason, is_hindi_body, source",
    (0, "kept", True, "Central Railway (RSB Hindi)"),
    (1, "duplicate", True, "Central Railway (RSB Hindi)"),
    (2, "kept", True, "Western Railway (RSB Hindi)"),
    (3, "not Hindi", False, "Northern Railway (RSB Hindi)"),
    (4, "outside the date window", True, "Northern Railway (RSB Hindi)"),
    (5, "outside the date window", True, "Northern Railway (RSB Hindi)"),
    (6, "untranslated template", False, "Eastern Railway (RSB Hindi)"),
    (7, "PDF-only (no inline text)", False, "Eastern Railway (RSB Hindi)"),
    (8, "9 chars", True, "Eastern Railway (RSB Hindi)"),
)


#: Windows and rules of the releases drawn from documents.
RELEASED = ("2024-01-03", "2024-01-25")


def zone_releases(spark, sf_dir):
    """Documents as releases of their sources, in Devanagari letters but for every fifth: all rules in one run, and what becomes of each."""
    docs = Q.articles(spark, sf_dir).withColumn("n", F.col("doc_id"))
    body = F.when(F.col("n") % 11 == 0, F.concat(F.left("body", F.lit(20)), F.lit(" Add Hindi content here"))).when(F.col("n") % 13 == 0, F.lit("x [PDF attached: x]")).when(F.col("n") % 5 != 0, F.translate("body", Q.LATIN, Q.DEVA)).otherwise(F.col("body"))
    day = F.when(F.col("n") % 9 != 0, F.format_string("%02d-01-2024", F.col("n") % 28 + 1)).otherwise("")
    rows = docs.select(F.col("n").alias("ord"), F.col("source").alias("zone_code"), F.concat(F.col("source"), F.lit(" zone")).alias("zone_name"), F.left(F.translate("title", Q.LATIN, Q.DEVA), F.lit(9)).alias("title"), day.alias("date"), F.lit("u").alias("link"), body.alias("body"))
    out = C.release_chain(rows, RELEASED, keywords=[Q.DEVA_TERMS[0], Q.DEVA_TERMS[2]], hindi_only=True, per_zone=150)
    return out.select("ord", "reason", "is_hindi_body", "title_hindi_ratio", "body_hindi_ratio", F.col("source"))


def _ratio(x: str) -> str:
    hi, en = Q._script(x, r"\x{0900}-\x{097F}"), Q._script(x, "a-zA-Z")
    return f"(CASE WHEN {hi} + {en} > 0 THEN {hi}::DOUBLE / ({hi} + {en}) ELSE 0.0 END)"


_zone = f"""SELECT doc_id AS ord, source AS zone_code, left(translate(title, '{Q.LATIN}', '{Q.DEVA}'), 9) AS title, CASE WHEN doc_id % 9 <> 0 THEN DATE '2024-01-01' + CAST(doc_id % 28 AS INT) END AS day,
CASE WHEN doc_id % 11 = 0 THEN left(body, 20) || ' Add Hindi content here' WHEN doc_id % 13 = 0 THEN 'x [PDF attached: x]' WHEN doc_id % 5 <> 0 THEN translate(body, '{Q.LATIN}', '{Q.DEVA}') ELSE body END AS body FROM ({Q.ART})"""
SQL["zone_releases"] = f"""WITH {Q.token_sql(f"SELECT * FROM ({_zone})", "title || ' ' || left(body, 600)")}, i AS (SELECT *, coalesce(day BETWEEN DATE '2024-01-03' AND DATE '2024-01-25', false) AS inside FROM t3),
p AS (SELECT *, inside AND row_number() OVER (PARTITION BY zone_code, inside ORDER BY ord) <= 150 AS take, CASE WHEN length(body) < 200 THEN CASE WHEN contains(body, 'Add Hindi content here') THEN 'untranslated template' WHEN contains(body, '[PDF attached:') THEN 'PDF-only (no inline text)' ELSE length(body) || ' chars' END END AS thin FROM i),
a AS (SELECT *, row_number() OVER (PARTITION BY zone_code, {Q.key("title")}, take AND thin IS NULL ORDER BY ord) > 1 AS again, {_ratio("body")} AS ratio, {_ratio("title")} AS title_ratio FROM p)
SELECT ord, CASE WHEN NOT inside THEN 'outside the date window' WHEN NOT take THEN 'beyond the cap' WHEN thin IS NOT NULL THEN thin WHEN again THEN 'duplicate' WHEN NOT (blob <> '' AND len({Q.hits_sql((Q.DEVA_TERMS[0], Q.DEVA_TERMS[2]))}) > 0) THEN 'no keyword match' WHEN ratio < 0.5 THEN 'not Hindi' ELSE 'kept' END AS reason,
ratio >= 0.5 AS is_hindi_body, round_even(title_ratio, 2) AS title_hindi_ratio, round_even(ratio, 2) AS body_hindi_ratio, zone_code || ' zone (RSB Hindi)' AS source FROM a"""


def release_keywords(spark, sf_dir):
    """An open window keeps undated releases; one release per zone and a keyword."""
    return C.release_chain(releases(spark), (None, None), keywords=["गाड़ी"], per_zone=1).where("reason in ('kept', 'no keyword match')").select("ord", "reason")


SQL["release_keywords"] = expected("ord, reason", (0, "kept"), (2, "kept"), (3, "no keyword match"))


def newest_releases(spark, sf_dir):
    return C.newest_release(releases(spark))


SQL["newest_releases"] = expected("zone_code, newest, overall", ("CR", "2024-01-28", False), ("WR", "2024-01-26", False), ("NR", "2024-01-29", True), ("ER", "2024-01-29", True))


def zone_repeats(spark, sf_dir):
    """Documents as releases of their source: how many titles repeat there, the empty one among them."""
    rows = Q.articles(spark, sf_dir).withColumnRenamed("source", "zone_code")
    return C.zone_dedup(rows, ["doc_id"]).groupBy("zone_code").agg(F.count_if("repeat").alias("repeats"))


SQL["zone_repeats"] = f"SELECT zone_code, count(*) FILTER (n > 1) AS repeats FROM (SELECT source AS zone_code, row_number() OVER (PARTITION BY coalesce(source, ''), {Q.key('title')} ORDER BY doc_id) AS n FROM ({Q.ART})) GROUP BY 1"


def zone_notes(spark, sf_dir):
    """Zones with addresses of the Hindi edition and their coverage notes."""
    zones = spark.createDataFrame([("CR", "https://cr/x?id=0,1&lang=0"), ("XX", "https://xx/?lang=1")], "zone_code string, url string")
    notes = spark.createDataFrame([("CR", "true")], "zone_code string, usable string")
    return C.with_coverage(zones, notes).select("zone_code", C.zone_address(F.col("url")).alias("url"), "usable")


SQL["zone_notes"] = expected("zone_code, url, usable", ("CR", "https://cr/x?id=0,1&lang=1", "true"), ("XX", "https://xx/?lang=1", None))


def listing_fallback(spark, sf_dir):
    """Recorded listing addresses, else the zone's, else the source's."""
    arts = spark.createDataFrame([(1, "", "Daily", ""), (2, "CR", "Daily", ""), (3, "CR", "x", "https://own"), (4, None, "Two", None), (5, "", "none", "")], "idx int, zone_code string, source string, listing_url string")
    known = spark.createDataFrame([("Daily", ["https://d"]), ("CR", ["https://cr"]), ("Two", ["https://a", "https://b"]), ("none", [])], "name string, start_urls array<string>")
    return C.listing_for(arts, known).select("idx", "listing", "listing_exact")


SQL["listing_fallback"] = expected("idx, listing, listing_exact", (1, "https://d", False), (2, "https://cr", False), (3, "https://own", True), (4, "https://a (+1 more)", False), (5, "", False))


def name_parts(spark, sf_dir):
    """Log names, errors, source names, cut titles, domains and rewritten addresses."""
    rows = spark.createDataFrame(
        [
            (1, "20240130-101500-web-crawl.log", "Traceback\n  x\nValueError: bad input", "Live Hindustan Indian Railways", "cut...", "https://www.pib.gov.in/PressReleaseDetail.aspx?PRID=1"),
            (2, "20240130-101500-rsb-two-score.log", "plain line\n\n", "Northern Railway (RSB Hindi)", "whole", "https://m.jansatta.com/x"),
            (3, "odd.log", "", " Press Releases", "", "nothing"),
        ],
        "id int, log string, error string, source string, title string, url string",
    )
    log = C.log_name_parts(F.col("log"))
    return rows.select("id", log["date"].alias("date"), log["pipeline"].alias("pipeline"), log["step"].alias("step"), C.plain_error(F.col("error")).alias("error"), X.short_source(F.col("source")).alias("source"), C.truncated_title(F.col("title")).alias("cut"), S.domain_key(F.col("url")).alias("domain"), P.article_address(F.col("url")).alias("address"))


SQL["name_parts"] = expected(
    'id, "date", pipeline, step, error, source, cut, domain, address',
    (1, "20240130", "web", "crawl", "bad input", "Live Hindustan", True, "pib.gov.in", "https://www.pib.gov.in/PressReleasePage.aspx?PRID=1"),
    (2, "20240130", "rsb-two", "score", "plain line", "Northern Railway", False, "jansatta.com", "https://m.jansatta.com/x"),
    (3, "", "", "", "", " Press Releases", True, "aajtak.in", "nothing"),
)


def env_settings(spark, sf_dir):
    lines = spark.createDataFrame([("# note",), ("export A=1",), ("B = \"two words\" ",), ("C='x=y'",), ("bad",), ("=none",)], "value string")
    return C.parse_env(lines)


SQL["env_settings"] = expected("key, value", ("A", "1"), ("B", "two words"), ("C", "x=y"))


def listing_cases(spark, sf_dir):
    """Links of a page, of a feed and of a publisher with a pattern."""
    page = '<link href="/style.css"><a href="/a/1.html#top">1</a><a href="../b/2.html">2</a><a href="http://m.x.com/3">3</a><a href="http://y.com/4">4</a><a href="/topic/5">5</a><a href="/a/1.html">1</a>'
    rows = [(1, "http://x.com/news/list/", page), (2, "https://www.x.com/feed", "<?xml?><rss><link>https://x.com/f1</link><link> https://z.org/f2 </link></rss>"), (3, "https://www.jansatta.com/rail/", '<a href="/rail/story/1234567/">a</a><a href="/rail/">b</a>')]
    out = S.listing_links(spark.createDataFrame(rows, "id int, url string, html string"), "id", "url", "html")
    return out.select("id", "ord", "link")


SQL["listing_cases"] = expected("id, ord, link", (1, 0, "http://x.com/news/b/2.html"), (1, 1, "http://m.x.com/3"), (1, 2, "http://x.com/a/1.html"), (2, 0, "https://x.com/f1"), (3, 0, "https://www.jansatta.com/rail/story/1234567/"))

LONG = "यह एक लंबा अनुच्छेद है जिसमें पर्याप्त पाठ है। " * 6


def page_cases(spark, sf_dir):
    """Bodies by publishers' rules and by the sweep, with dates and titles; other content has none."""
    rows = [
        (1, "https://www.aajtak.in/story/1", f'<meta property="og:title" content=" T1 "><meta name="publishdate" content="2024-01-05T10:00"><div class="content-area x"><p>{LONG}</p><script>no</script></div><p>{LONG}</p>', "text/html"),
        (2, "https://x.com/2", f'<time datetime="2024-02-03 x"></time><nav><p>{LONG}</p></nav><h1>Head</h1><p>short</p><p>{LONG}</p>', "text/html; charset=utf-8"),
        (3, "https://x.com/3", f"<p>{LONG}</p>", "application/pdf"),
        (4, "https://navbharattimes.indiatimes.com/4", f'<div class="big articleshow-body">{LONG}<div class="ad_slot">buy</div></div>', "text/html"),
        (5, "https://pib.gov.in/5", f'<div class="pressrelease"><p>tiny</p><p>{LONG}</p></div>', "text/html"),
    ]
    out = P.article_pages(spark.createDataFrame(rows, "id int, url string, html string, kind string"), "url", "html", "kind")
    return out.select("id", "extractor", F.length("body").alias("chars"), "page_date", F.left("page_title", F.lit(10)).alias("title"))


_long = len(LONG.strip())
SQL["page_cases"] = expected("id, extractor, chars, page_date, title", (1, "aajtak.in", _long, "2024-01-05", "T1"), (2, "generic", _long, "2024-02-03", "Head"), (3, "", 0, "", ""), (4, "navbharattimes.indiatimes.com", _long, "", LONG[:10]), (5, "pib.gov.in", _long, "", LONG[:10]))


def extractors(spark, sf_dir):
    """How many of all pages each extractor read, and how many have a date."""
    rows = P.article_pages(Q.table(spark, sf_dir, "pages"), "url", "html")
    return rows.groupBy("extractor").agg(F.count("*").alias("n"), F.count_if(F.col("page_date") != "").alias("dated"))


def clusters(spark, sf_dir, mode) -> DataFrame:
    rows = Q.articles(spark, sf_dir)
    members = T.cluster_members(rows, mode, "doc_id", topics=V.PLAIN_TOPICS)
    return T.cluster_rollup(members, rows, "doc_id")


def cluster_table(spark, sf_dir):
    """Story clusters with lead, sources and the topics of their members in the order first seen."""
    return clusters(spark, sf_dir, "story").select("cluster", "size", "lead", "chars", F.array_join("sources", ",").alias("sources"), F.array_join("topics", ",").alias("topics"))


_topics = f"""t AS (WITH {Q.token_sql(Q.ART, "title || ' ' || body")} SELECT doc_id, list_transform(list_slice(list_sort(list_transform({V.evidence_sql(V.PLAIN_TOPICS)}, lambda x: {{'n': -len(x.hits), 'topic': x.topic}})), 1, 3), lambda x: x.topic) AS topics FROM t3)"""
SQL["cluster_table"] = f"""{Q.CLUSTER}, {_topics}, o AS (SELECT doc_id, cluster, source, length(body) AS chars, row_number() OVER (PARTITION BY cluster ORDER BY length(body) DESC, doc_id) AS place FROM c),
x AS (SELECT cluster, unnest(topics) AS topic, place, generate_subscripts(topics, 1) AS nth FROM o JOIN t USING (doc_id)), y AS (SELECT cluster, topic, min(place * 10 + nth) AS s FROM x GROUP BY 1, 2), z AS (SELECT cluster, string_agg(topic, ',' ORDER BY s) AS topics FROM y GROUP BY 1)
SELECT CAST(cluster AS VARCHAR) AS cluster, count(*) AS size, max(doc_id) FILTER (place = 1) AS lead, sum(chars)::BIGINT AS chars, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, coalesce(any_value(topics), '') AS topics FROM o LEFT JOIN z USING (cluster) GROUP BY cluster"""


def run_estimates(spark, sf_dir):
    """What a run costs in each mode when the articles of even ids are written and those of ids by four are scored."""
    rows = Q.articles(spark, sf_dir)
    rollups = {m: clusters(spark, sf_dir, m) for m in T.MODES}
    return T.run_estimate(rollups, rows.where("doc_id % 2 = 0"), rows.where("doc_id % 4 = 0"))


_rk = rf"trim(regexp_replace(lower(title), '{Q.W}', ' ', 'g'))"
SQL["run_estimates"] = f"""{Q.CLUSTER}, {_topics}, g AS (SELECT 'off' AS mode, CAST(doc_id AS VARCHAR) AS g, doc_id FROM art UNION ALL SELECT 'story', CAST(cluster AS VARCHAR), doc_id FROM c UNION ALL SELECT 'topic', coalesce(topics[1], 'Unclassified'), doc_id FROM t),
l AS (SELECT mode, {_rk} AS k FROM g JOIN art USING (doc_id) QUALIFY row_number() OVER (PARTITION BY mode, g ORDER BY length(body) DESC, doc_id) = 1), done AS (SELECT DISTINCT {_rk} AS k FROM art WHERE doc_id % 2 = 0), scored AS (SELECT DISTINCT {_rk} AS k FROM art WHERE doc_id % 4 = 0)
SELECT mode, count(*) AS counts, count(*) FILTER (k NOT IN (SELECT k FROM done)) AS calls, count(*) FILTER (k IN (SELECT k FROM done)) AS skipped, count(*) FILTER (k IN (SELECT k FROM done) AND k IN (SELECT k FROM scored)) AS checked FROM l GROUP BY mode"""


def cluster_summary(spark, sf_dir):
    return T.summary_line(clusters(spark, sf_dir, "story"))


SQL["cluster_summary"] = f"{Q.CLUSTER} SELECT sum(n)::BIGINT AS articles, count(*) AS reports, count(*) FILTER (n > 1) AS multi FROM (SELECT cluster, count(*) AS n FROM c GROUP BY cluster)"


def cluster_preview(spark, sf_dir):
    """Clusters of the selected articles alone, with the articles' own ids: those of sources b* stand for discarded ones."""
    rows = Q.articles(spark, sf_dir).where("doc_id % 3 <> 0")
    members = T.cluster_members(rows, "topic", "doc_id", topics=V.PLAIN_TOPICS)
    return members.groupBy("cluster").agg(F.count("*").alias("size"), F.min("idx").alias("first"), F.max("idx").alias("last"))


SQL["cluster_preview"] = f"WITH {_topics} SELECT coalesce(topics[1], 'Unclassified') AS cluster, count(*) AS size, min(doc_id) AS first, max(doc_id) AS last FROM t WHERE doc_id % 3 <> 0 GROUP BY 1"


def scored(spark, sf_dir) -> DataFrame:
    rows = Q.pairs(spark, sf_dir).withColumnRenamed("story", "ai_news_story")
    rows = rows.withColumns({"topics": F.array(F.lit("fruit"), F.lit("motion"), F.lit("weather")), "impact_level": F.when(F.col("doc_id") % 2 == 0, "Low").otherwise("High")})
    return T.score_articles(rows, strong=Q.STRONG, weak=Q.WEAK, vocabulary=V.PLAIN_TOPICS)


def article_scores(spark, sf_dir):
    """All checks of each article in one call."""
    return scored(spark, sf_dir).select("doc_id", "coverage_score", "number_precision", "gates_passed", "grounding_ceiling", F.array_join("topics_verified", ",").alias("verified"), F.array_join("topics_unsupported", ",").alias("unsupported"), F.array_join("topics_off_vocabulary", ",").alias("off"), "impact_rule_level", "impact_agrees")


_scored = f"""WITH b AS (WITH {Q.token_sql(Q.PAIR, "body")} SELECT *, list_transform({V.evidence_sql(V.PLAIN_TOPICS)}, lambda x: x.topic) AS named, len({Q.hits_sql(Q.L.IMPACT_HIGH)}) AS hi, len({Q.hits_sql(Q.L.IMPACT_MEDIUM)}) AS me FROM t3), g AS ({Q.SQL["grounding_gates"]}), n AS ({Q.SQL["number_coverage"]}),
s AS (SELECT doc_id, coverage_score, number_precision, gates_passed, grounding_ceiling, list_filter(['fruit', 'motion'], lambda x: list_contains(named, x)) AS v, list_filter(['fruit', 'motion'], lambda x: NOT list_contains(named, x)) AS u, CASE WHEN hi > 0 THEN 'High' WHEN me > 0 THEN 'Medium' ELSE 'Low' END AS rule FROM b JOIN g USING (doc_id) JOIN n USING (doc_id))"""
SQL["article_scores"] = f"{_scored} SELECT doc_id, coverage_score, number_precision, gates_passed, grounding_ceiling, array_to_string(v, ',') AS verified, array_to_string(u, ',') AS unsupported, 'weather' AS off, rule AS impact_rule_level, rule = CASE WHEN doc_id % 2 = 0 THEN 'Low' ELSE 'High' END AS impact_agrees FROM s"


def topic_report(spark, sf_dir):
    # three reports read the verdicts from one checkpoint
    rows = A.checkpointed(scored(spark, sf_dir).select("doc_id", "topics", "topics_off_vocabulary", "topics_unsupported", "impact_agrees"))
    top = T.unsupported_topics(rows, "doc_id").agg(F.array_join(F.collect_list(F.concat_ws(":", "topic", "n")), ",").alias("top"))
    agree = T.impact_agreement(rows).select("agree", "percent")
    return T.topic_report(rows).crossJoin(top).crossJoin(agree)


SQL["topic_report"] = f"""{_scored}, c AS (SELECT t, count(*) AS n, min(doc_id) AS first FROM (SELECT unnest(u) AS t, doc_id FROM s) GROUP BY t) SELECT count(*) * 3 AS assigned, count(*) AS off_vocabulary, sum(len(u))::BIGINT AS unsupported, (SELECT string_agg(t || ':' || n, ',' ORDER BY n DESC, first, t) FROM c) AS top,
count(*) FILTER (rule = CASE WHEN doc_id % 2 = 0 THEN 'Low' ELSE 'High' END) AS agree, CAST(round_even(100.0 * count(*) FILTER (rule = CASE WHEN doc_id % 2 = 0 THEN 'Low' ELSE 'High' END) / count(*), 0) AS INT) AS percent FROM s"""

STORIES = [
    (0, "रेल", "हिंदी पाठ", "hi", "हिंदी कहानी जो काफ़ी लंबी है और पूरी भी है", "An English translation that is long enough", 80, 10, "a"),
    (1, "Rail", "English text", "en", "An English story of some length, written out", "हिंदी अनुवाद जो पर्याप्त रूप से लंबा भी है", 60, 25, "b"),
    (2, "Rail", "English text", "en", "[Not generated]", "", None, None, "a"),
    (3, "Rail", None, None, "Generation failed: x", "Short", 40, 0, None),
]
STORY = "idx int, title string, body string, source_lang string, ai_news_story string, ai_news_story_translated string, fact_score int, plagiarism_score int, source string"


def bilingual_summary(spark, sf_dir):
    out = T.bilingual_summary(spark.createDataFrame(STORIES, STORY))
    return out.select("total_articles", "generated_articles", "bilingual_complete_articles", "bilingual_complete_pct", "source_has_hindi_articles", "hindi_in_ai_story_articles", "hindi_in_translation_articles", "avg_fact_score_all", "avg_fact_score_hindi_related", "avg_plagiarism_score_all", "avg_plagiarism_score_hindi_related")


SQL["bilingual_summary"] = "SELECT 4::BIGINT AS total_articles, 2::BIGINT AS generated_articles, 3::BIGINT AS bilingual_complete_articles, 75.0::DOUBLE AS bilingual_complete_pct, 1::BIGINT AS source_has_hindi_articles, 1::BIGINT AS hindi_in_ai_story_articles, 1::BIGINT AS hindi_in_translation_articles, 60.0::DOUBLE AS avg_fact_score_all, 70.0::DOUBLE AS avg_fact_score_hindi_related, 11.67::DOUBLE AS avg_plagiarism_score_all, 17.5::DOUBLE AS avg_plagiarism_score_hindi_related"


def bilingual_cases(spark, sf_dir):
    return T.bilingual_scores(spark.createDataFrame(STORIES, STORY)).select("idx", "bilingual_score", "hindi_information_score")


SQL["bilingual_cases"] = expected("idx, bilingual_score, hindi_information_score", (0, 100, 70), (1, 100, 30), (2, 25, 0), (3, 0, 0))


def hindi_listing(spark, sf_dir):
    return T.hindi_related(spark.createDataFrame(STORIES, STORY)).select("idx", "source", "story_has_hindi", "translation_has_hindi", "title")


SQL["hindi_listing"] = expected("idx, source, story_has_hindi, translation_has_hindi, title", (0, "a", True, False, "रेल"), (1, "b", False, True, "Rail"))


def source_histogram(spark, sf_dir):
    """The ten most frequent sources, equal ones by first appearance."""
    return T.histogram(Q.articles(spark, sf_dir).withColumnRenamed("doc_id", "idx"), "source", 10)


SQL["source_histogram"] = f"""SELECT coalesce(source, 'unknown') AS source, count(*) AS n, min(doc_id) AS first FROM ({Q.ART}) GROUP BY 1 ORDER BY n DESC, first LIMIT 10"""


def resumed_run(spark, sf_dir):
    """A run taken up again: finished stories stay, those cut off are written anew, and a new row replaces the old one of its title."""
    kinds = "title string, ai_news_story string, topics array<string>, fact_details string, truncated boolean"
    old = spark.createDataFrame([("A  b", "a story", ["x"], "d", False), ("c", "cut", ["x"], "d", True), ("d", "no flag", [], "", None), ("e", "[Not generated]", ["x"], "d", None)], kinds)
    inputs = spark.createDataFrame([(" a B ", 1), ("c", 2), ("d", 3), ("e", 4), ("f", 5)], "title string, n int")
    todo = T.to_write(inputs, old)
    new = todo.select("title", F.concat(F.lit("new "), "title").alias("ai_news_story"), F.array(F.lit("x")).alias("topics"), F.lit("d").alias("fact_details"), F.lit(False).alias("truncated"))
    return T.upserted(old, new).select("title", "ai_news_story")


SQL["resumed_run"] = expected("title, ai_news_story", ("A  b", "a story"), ("c", "new c"), ("d", "new d"), ("e", "new e"), ("f", "new f"))


def selection_steps(spark, sf_dir):
    """Exclude, include and clear keys of documents; a key that no article has is dropped."""
    arts = Q.articles(spark, sf_dir).withColumn("key", F.col("doc_id").cast("string"))
    none = arts.select("key").limit(0)
    first = T.changed_selection(none, arts, "exclude", arts.where("doc_id % 3 = 0").select("key").unionByName(spark.createDataFrame([("gone",)], "key string")))
    second = T.changed_selection(first, arts, "include", arts.where("doc_id % 2 = 0").select("key"))
    third = T.changed_selection(second, arts, "clear_excluded")
    counts = lambda name, x: T.selection_view(arts, x, "all").groupBy(F.lit(name).alias("step")).agg(F.count("*").alias("total"), F.count_if(~F.col("is_excluded")).alias("selected"), F.count_if("is_excluded").alias("excluded"))
    return counts("exclude", first).unionByName(counts("include", second)).unionByName(counts("clear", third))


SQL["selection_steps"] = "SELECT step, count(*) AS total, count(*) FILTER (NOT x) AS selected, count(*) FILTER (x) AS excluded FROM (SELECT 'exclude' AS step, doc_id % 3 = 0 AS x FROM documents UNION ALL SELECT 'include', doc_id % 3 = 0 AND doc_id % 2 <> 0 FROM documents UNION ALL SELECT 'clear', false FROM documents) GROUP BY step"


def selection_views(spark, sf_dir):
    """Discarded articles that hold a text."""
    arts = Q.articles(spark, sf_dir).withColumn("key", F.col("doc_id").cast("string"))
    return T.selection_view(arts, arts.where("doc_id % 3 = 0").select("key"), "excluded", " ERINER ").select("doc_id")


SQL["selection_views"] = f"SELECT doc_id FROM ({V.SQL['article_search']}) WHERE doc_id % 3 = 0"

POSTS = [(1, "en", "An English post", "हिंदी पोस्ट", "", "", "Only English", "English again"), (2, "hi", "", "", "हिंदी", "", "", "")]
POST = "id int, source_lang string, social_twitter string, social_twitter_translated string, social_facebook string, social_facebook_translated string, social_general string, social_general_translated string"


def social_panels(spark, sf_dir):
    return T.social_panels(spark.createDataFrame(POSTS, POST), "id").select("id", "network", "place", "lang", "text", "shown")


SQL["social_panels"] = expected("id, network, place, lang, text, shown", (1, "twitter", 0, "hi", "हिंदी पोस्ट", True), (1, "twitter", 1, "en", "An English post", False), (1, "general", 0, "en", "Only English", True), (2, "facebook", 0, "hi", "हिंदी", True))


def detail_rows(spark, sf_dir):
    """Filled fields of the articles, by kind."""
    rows = Q.articles(spark, sf_dir).withColumn("tags", F.array(F.lit("a"), F.col("lang")))
    return T.detail_rows(rows, "doc_id").groupBy("kind", "field").agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("chars"))


SQL["detail_rows"] = f"""SELECT kind, field, count(*) AS n, sum(length(value))::BIGINT AS chars FROM (SELECT 'value' AS kind, 'title' AS field, title AS value FROM ({Q.ART}) UNION ALL SELECT 'source', 'body', body FROM ({Q.ART}) UNION ALL SELECT 'value', 'source', source FROM ({Q.ART}) UNION ALL SELECT 'value', 'lang', lang FROM ({Q.ART})
UNION ALL SELECT 'value', 'tags', 'a, ' || lang FROM ({Q.ART})) WHERE coalesce(value, '') <> '' GROUP BY 1, 2"""

SCORES = [(1, 70, 10, "x", 80, 95, 100, True), (2, 20, 0, "Insufficient text for comparison.", 40, 80, 15, False), (3, None, None, None, 90, None, None, None)]


def quality_badges(spark, sf_dir):
    rows = spark.createDataFrame(SCORES, "id int, coverage_score int, plagiarism_score int, plagiarism_detail string, fact_score int, number_precision int, grounding_ceiling int, gates_passed boolean")
    return R.badges(rows).select("id", F.array_join(F.transform("badges", lambda b: F.concat_ws("=", b["name"], b["band"])), " ").alias("bands"), "needs_look")


SQL["quality_badges"] = expected(
    "id, bands, needs_look",
    (1, "fact_score=ok plagiarism_score=ok coverage_score=ok number_precision=ok grounding_ceiling=ok", False),
    (2, "fact_score=err plagiarism_score=none coverage_score=err number_precision=warn grounding_ceiling=err", True),
    (3, "fact_score=ok plagiarism_score=none coverage_score=none number_precision=none grounding_ceiling=none", False),
)

TABS = [(1, "en", "Head", "An English story", "शीर्षक", "हिंदी कहानी"), (2, "hi", "शीर्षक", "कहानी", "", ""), (3, "en", "", "one", "", "two")]


def story_tabs(spark, sf_dir):
    rows = spark.createDataFrame(TABS, "id int, source_lang string, ai_headline string, ai_news_story string, ai_headline_translated string, ai_news_story_translated string")
    return R.story_tabs(rows, "id").select("id", "place", "role", "label")


SQL["story_tabs"] = expected("id, place, role, label", (1, 1, "translation", "Hindi"), (1, 2, "original", "English"), (2, 1, "original", "Hindi"), (3, 1, "original", "English"), (3, 2, "translation", "English (translation)"))


def merged_parts(spark, sf_dir):
    """Merged bodies of all title groups, split again: as many parts as members."""
    rows = Q.articles(spark, sf_dir).withColumn("k", X.normal_key(F.col("title"))).where("k <> ''").withColumn("date", F.lit(""))
    merged = A.merged_bodies(rows, "k", "doc_id", "source", "date", "body")
    out = merged.where("cluster_size > 1").withColumn("p", R.merged_parts(F.col("body")))
    return out.select("k", "cluster_size", F.size("p").alias("parts"), F.array_join(F.transform("p", lambda x: x["source"]), ",").alias("sources"))


SQL["merged_parts"] = f"WITH k AS (SELECT *, {Q.key('title')} AS k FROM ({Q.ART})) SELECT k, CAST(count(*) AS INT) AS cluster_size, CAST(count(*) AS INT) AS parts, string_agg(source, ',' ORDER BY length(body) DESC, doc_id) AS sources FROM k WHERE k <> '' GROUP BY k HAVING count(*) > 1"

FEED = '<rss><channel><item><title>A &amp; B</title><link>http://www.bing.com/c?url=https%3a%2f%2fx.com%2f1</link><pubDate>Mon, 05 Feb 2024 10:00:00 GMT</pubDate><News:Source>X</News:Source><description>d</description></item><item><title>no link</title></item><item><link>https://www.y.com/2</link><title><![CDATA[C]]></title></item></channel></rss>'


def feed_hits(spark, sf_dir):
    rows = spark.createDataFrame([("q", "l", FEED)], "query string, listing string, xml string")
    return S.rss_hits(rows, "xml", "query", "listing", "bing").select("ord", "url", "title", "source", "date")


SQL["feed_hits"] = expected('ord, url, title, source, "date"', (0, "https://x.com/1", "A & B", "X", "2024-02-05"), (2, "https://www.y.com/2", "C", "y.com", ""))


def result_hits(spark, sf_dir):
    found = '[{"title": "T &quot;x&quot;", "url": "https://www.z.com/1", "description": "a <strong>b</strong>", "page_age": "2024-02-05T00:00:00", "meta_url": {"hostname": "www.z.com"}}, {"title": "no url"}]'
    rows = spark.createDataFrame([("q", "l", found)], "query string, listing string, results string")
    return S.json_hits(rows, "results", "query", "listing", "brave").select("ord", "url", "title", "source", "date", "snippet")


SQL["result_hits"] = expected('ord, url, title, source, "date", snippet', (0, "https://www.z.com/1", 'T "x"', "z.com", "2024-02-05", "a b"))


def warning_lines(spark, sf_dir):
    lines = spark.createDataFrame([(1, "all well"), (2, "SKIP this"), (3, "KeyError: x"), (4, "step FAILED"), (5, "WARNING: y")], "id int, line string")
    return lines.select("id", ST.warns(F.col("line")).alias("warns"))


SQL["warning_lines"] = expected("id, warns", (1, False), (2, True), (3, True), (4, True), (5, True))

NAMES = tuple(n for n in SQL) + ("extractors",)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: globals()[n] for n in NAMES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
