"""The article engine's queries over the test tables, each with its SQL twin.

documents stand in for articles (title: first line, 120 characters), pages for
fetched pages, events for dated rows, neighbouring documents for stories and
their sources.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from akshara.functions import lexicon as L
from akshara.functions import text as X
from akshara.operators import articles as A
from akshara.operators import stories as ST

#: Words that play the part of a subject in the generated English texts.
STRONG, WEAK = ("apple", "theanther", "erthe on"), ("thion", "oning", "theand", "and the")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.left(F.substring_index("text", "\n", 1), F.lit(120)).alias("title"), F.col("text").alias("body"), "source", "lang")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a source, the next as its story."""
    docs = table(spark, sf_dir, "documents")
    story = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("story"))
    return docs.select("doc_id", F.left(F.substring_index("text", "\n", 1), F.lit(120)).alias("title"), F.col("text").alias("body"), "source").join(story, "doc_id")


ART = r"SELECT doc_id, left(split_part(text, chr(10), 1), 120) AS title, text AS body, source, lang FROM documents"
PAIR = r"SELECT a.doc_id, left(split_part(a.text, chr(10), 1), 120) AS title, a.text AS body, a.source, b.text AS story FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1"
W = r"[\s\p{Z}]+"


def norm(x: str) -> str:
    return rf"trim(regexp_replace(nfc_normalize(translate(coalesce({x}, ''), '{L.ZERO_WIDTH}', '')), '{W}', ' ', 'g'))"


def key(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({norm(x)}), '[^a-z0-9\x{{0900}}-\x{{097F}}\s\p{{Z}}]', '', 'g'), '{W}', ' ', 'g'))"


def nums(x: str) -> str:
    runs = rf"list_transform(regexp_extract_all(translate(coalesce({x}, ''), '०१२३४५६७८९', '0123456789'), '[0-9][0-9,.:/\-]*'), lambda r: replace(r, ',', ''))"
    return rf"list_distinct(list_transform(flatten(list_transform({runs}, lambda r: list_filter(string_split_regex(r, '[.:/\-]'), lambda p: p <> ''))), lambda p: CASE WHEN regexp_replace(p, '^0+', '') = '' THEN '0' ELSE regexp_replace(p, '^0+', '') END))"


def value_order(x: str) -> str:
    return f"list_transform(list_sort(list_transform({x}, lambda v: {{'n': length(v), 'v': v}})), lambda s: s.v)"


def minus(a: str, b: str) -> str:
    return f"list_filter({a}, lambda v: NOT list_contains({b}, v))"


def stem(x: str) -> str:
    cases = " ".join(f"WHEN ends_with({x}, '{s}') AND length({x}) >= {len(s) + 2} THEN left({x}, length({x}) - {len(s)})" for s in L.SUFFIXES)
    return rf"regexp_replace(CASE {cases} ELSE {x} END, '^(.{{2}}.*?)[{L.MATRAS}]+$', '\1')"


def words_sql(x: str, hi: int = 2, en: int = 3) -> str:
    return rf"list_distinct(list_concat(regexp_extract_all({x}, '[\x{{0900}}-\x{{097F}}]{{{hi},}}'), regexp_extract_all(lower({x}), '[a-z]{{{en},}}')))"


def title_sql(x: str) -> str:
    generic = ", ".join(f"'{w}'" for w in L.GENERIC)
    return rf"list_distinct(list_filter(regexp_extract_all(lower(regexp_replace({x}, '[\s\p{{Z}}]*[-–—|][\s\p{{Z}}]*[A-Z][\p{{L}}\p{{N}}_\s\p{{Z}},.]+$', '')), '[a-z]{{4,}}'), lambda w: w NOT IN ({generic})))"


def number_coverage(spark, sf_dir):
    # the figures meet, joined by blanks, and not the texts
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.numbers(F.col("text")), " ").alias("body"))
    out = A.coverage(docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("body").alias("story")), "doc_id"), "body", "story")
    return out.select("doc_id", "coverage_score", "number_precision", "source_numbers", "story_numbers", "numbers_carried", F.array_join("numbers_unsupported", ",").alias("unsupported"), F.array_join("numbers_missed", ",").alias("missed"), "coverage_detail")


COVERAGE = f"""WITH p AS (SELECT *, {nums("body")} AS a, {nums("story")} AS b FROM ({PAIR})), c AS (SELECT *, len(list_intersect(a, b)) AS n, len(a) > 0 AND len(b) > 0 AS ok FROM p),
s AS (SELECT *, CASE WHEN ok THEN CAST(round_even(100.0 * n / len(a), 0) AS INT) END AS coverage_score, CASE WHEN ok THEN CAST(round_even(100.0 * n / len(b), 0) AS INT) END AS number_precision FROM c)"""

SQL: dict[str, str] = {}
SQL["number_coverage"] = f"""{COVERAGE} SELECT doc_id, coverage_score, number_precision, CAST(len(a) AS INT) AS source_numbers, CAST(len(b) AS INT) AS story_numbers, CAST(CASE WHEN ok THEN n ELSE 0 END AS INT) AS numbers_carried,
CASE WHEN ok THEN array_to_string({value_order(minus("b", "a"))}, ',') ELSE '' END AS unsupported, CASE WHEN ok THEN array_to_string({value_order(minus("a", "b"))}, ',') ELSE '' END AS missed,
CASE WHEN ok THEN (CASE WHEN coverage_score >= 60 THEN 'Comprehensive' WHEN coverage_score >= 30 THEN 'Selective' ELSE 'Sparse' END) || ': story carries ' || n || ' of ' || len(a) || ' source figures.' ELSE 'Insufficient numeric content for comparison.' END AS coverage_detail FROM s"""


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pairs() after the gates. The figures of texts meet, joined by blanks, and of the texts only the beginnings that gates look at."""
    docs = articles(spark, sf_dir).select("doc_id", "title", F.left("body", F.lit(600)).alias("body"), F.array_join(X.numbers(F.col("body")), " ").alias("figures"))
    story = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.left("body", F.lit(60)).alias("story"), F.col("figures").alias("told"))
    out = A.with_tokens(A.coverage(docs.join(story, "doc_id"), "figures", "told"), F.concat_ws(" ", "title", "body"))
    return A.gates(out, "title", "body", "story", ~A.relevant(strong=STRONG, weak=WEAK))


def grounding_gates(spark, sf_dir):
    return gated(spark, sf_dir).select("doc_id", "gates_passed", "grounding_ceiling", F.array_join("gate_failures", "; ").alias("gate_failures"))


def hits_sql(terms, blob="blob", words="words", stems="stems") -> str:
    cases = [f"CASE WHEN contains({blob}, '{t}') THEN '{t}' END" if " " in t else f"CASE WHEN list_contains({words}, '{t}') OR list_contains({stems}, {stem(chr(39) + t + chr(39))}) THEN '{t}' END" for t in terms]
    return f"list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)"


def token_sql(inner: str, text: str) -> str:
    return f"t1 AS (SELECT *, lower({norm(text)}) AS blob FROM ({inner})), t2 AS (SELECT *, {words_sql('blob')} AS words FROM t1), t3 AS (SELECT *, list_transform(words, lambda w: {stem('w')}) AS stems FROM t2)"


SQL["grounding_gates"] = f"""{COVERAGE}, {token_sql("SELECT * FROM s", "title || ' ' || left(body, 600)")},
g AS (SELECT *, NOT (len({hits_sql(STRONG)}) > 0 OR len({hits_sql(WEAK)}) >= 2) AS off, length(body) < 300 AS short, (story IS NULL OR length(story) < 30 OR starts_with(story, 'Generation failed') OR starts_with(story, '[Not generated')) AS bad, CASE WHEN ok THEN len({minus("b", "a")}) ELSE 0 END AS u FROM t3)
SELECT doc_id, NOT (off OR short OR bad OR coalesce(number_precision < 90, false)) AS gates_passed, CAST(least(100, CASE WHEN off OR bad THEN 0 ELSE 100 END, CASE WHEN short THEN 20 ELSE 100 END, CASE WHEN coalesce(number_precision < 90, false) THEN greatest(0, 100 - 15 * u) ELSE 100 END) AS INT) AS grounding_ceiling,
concat_ws('; ', CASE WHEN off THEN 'off-topic source (no railway content)' END, CASE WHEN short THEN 'source body under 300 chars' END, CASE WHEN bad THEN 'degenerate story' END, CASE WHEN number_precision < 90 THEN number_precision || '% numeric precision — ' || u || ' unsupported figure(s)' END) AS gate_failures FROM g"""

FIXTURE = [
    (1, "रेलगाड़ियों का आंशिक रद्दीकरण / पुनर्निर्धारण"),
    (2, "प्रशिक्षण ट्रेनिंग कार्यक्रम आयोजित"),
    (3, "भारतीय क्रिकेट टीम के मुख्य कोच गौतम गंभीर"),
    (4, "हावड़ा और हावड़ा में नई ट्रेन का उद्घाटन - अमर उजाला"),
    (5, "रात ८ बजे 1,53,000 यात्री, 28/29.08 को ट्रैक पर रद्द"),
    (6, "Railway accident at 00:40, 12 injured in collision"),
    (7, ""),
    (8, "दुर्घटनाओं में मौत — रेल मंत्रालय की मंजूरी"),
]
VALUES = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in FIXTURE) + ") AS v(id, text)"


def fixture(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FIXTURE, "id int, text string")


def bi_script_terms(spark, sf_dir):
    out = A.impact(A.with_tokens(fixture(spark), F.col("text")), F.lit("High"))
    return out.select("id", A.relevant().alias("relevant"), "impact_rule_level", "impact_agrees", F.array_join("impact_evidence", ",").alias("impact_evidence"), F.array_join(F.array_sort("stems"), " ").alias("stems"))


SQL["bi_script_terms"] = f"""WITH {token_sql(VALUES, "text")}, h AS (SELECT *, {hits_sql(L.IMPACT_HIGH)} AS hi, {hits_sql(L.IMPACT_MEDIUM)} AS me FROM t3)
SELECT id, len({hits_sql(L.STRONG)}) > 0 OR len({hits_sql(L.WEAK)}) >= 2 AS relevant, CASE WHEN len(hi) > 0 THEN 'High' WHEN len(me) > 0 THEN 'Medium' ELSE 'Low' END AS impact_rule_level, len(hi) > 0 AS impact_agrees,
array_to_string(list_slice(CASE WHEN len(hi) > 0 THEN hi ELSE me END, 1, 5), ',') AS impact_evidence, array_to_string(list_sort(list_distinct(stems)), ' ') AS stems FROM h"""


def bi_script_keys(spark, sf_dir):
    words = X.title_words(F.col("text"))
    return fixture(spark).select("id", X.normal_key(F.col("text")).alias("title_key"), F.md5(X.normal_key(F.col("text"))).alias("dedup_key"), F.round(X.script_ratio(F.col("text")), 6).alias("ratio"), X.has_devanagari(F.col("text")).alias("devanagari"), F.array_join(F.array_sort(words), " ").alias("words"), F.array_join(X.by_value(X.numbers(F.col("text"))), ",").alias("numbers"))


_deva, _latin = r"length(regexp_replace(text, '[^\x{0900}-\x{097F}]', '', 'g'))", "length(regexp_replace(text, '[^a-zA-Z]', '', 'g'))"
_both = ", ".join(f"'{w}'" for w in (*L.STOPWORDS, *L.GENERIC))
_mixed = words_sql(rf"regexp_replace({norm('text')}, '[\s\p{{Z}}]+[-–—|][\s\p{{Z}}]+[^-–—|]{{2,30}}$', '')", 3, 4)
SQL["bi_script_keys"] = f"""SELECT id, {key("text")} AS title_key, md5({key("text")}) AS dedup_key, round(CASE WHEN {_deva} + {_latin} > 0 THEN {_deva}::DOUBLE / ({_deva} + {_latin}) ELSE 0.0 END, 6) AS ratio, {_deva} > 0 AS devanagari,
array_to_string(list_sort(CASE WHEN {_deva} > 0 THEN list_filter({_mixed}, lambda w: w NOT IN ({_both})) ELSE {title_sql("text")} END), ' ') AS words, array_to_string({value_order(nums("text"))}, ',') AS numbers FROM ({VALUES})"""


#: Stand-ins for a-z, so that the texts of the tables have Devanagari words with suffixes, vowel signs and digits.
LATIN, DEVA = "abcdefghijklmnopqrstuvwxyz0123456789", "ाबचदेफगहिजकलमनोपकरसतुवयखय़ज०१२३४५६७८९".replace("\u092f\u093c", "ँ")
DEVA_TERMS = tuple(w.translate(str.maketrans(LATIN, DEVA)) for w in ("the", "erthe", "tion", "apple", "oneror", "and the"))


def deva_articles(spark, sf_dir) -> DataFrame:
    docs = A.dealt(articles(spark, sf_dir), "doc_id")
    return docs.select("doc_id", F.translate("title", LATIN, DEVA).alias("title"), F.translate("body", LATIN, DEVA).alias("body"))


DEVA_ART = f"SELECT doc_id, translate(title, '{LATIN}', '{DEVA}') AS title, translate(body, '{LATIN}', '{DEVA}') AS body FROM ({ART})"


def deva_terms(spark, sf_dir):
    """Whole documents in Devanagari letters: listed terms found as tokens, by stems and as phrases, and the stems themselves."""
    rows = A.with_tokens(deva_articles(spark, sf_dir), F.col("body"))
    hits = X.term_hits(DEVA_TERMS, F.col("blob"), F.col("words"), F.col("stems"))
    return rows.select("doc_id", F.array_join(hits, ",").alias("hits"), F.size("words").alias("n_words"), F.size("stems").alias("n_stems"), F.md5(F.array_join(F.array_sort("stems"), " ")).alias("stems_md5"))


SQL["deva_terms"] = f"""WITH {token_sql(DEVA_ART, "body")} SELECT doc_id, array_to_string({hits_sql(DEVA_TERMS)}, ',') AS hits, CAST(len(words) AS INT) AS n_words, CAST(len(list_distinct(stems)) AS INT) AS n_stems, md5(array_to_string(list_sort(list_distinct(stems)), ' ')) AS stems_md5 FROM t3"""


def deva_keys(spark, sf_dir):
    """Titles and bodies of documents in Devanagari letters: keys, shares of script, words that tell titles apart, figures."""
    rows = deva_articles(spark, sf_dir)
    numbers = F.array_join(X.by_value(X.numbers(F.col("body"))), ",")
    return rows.select("doc_id", F.md5(X.normal_key(F.col("body"))).alias("body_key"), F.round(X.script_ratio(F.col("body")), 6).alias("ratio"), X.has_devanagari(F.col("title")).alias("devanagari"), F.array_join(F.array_sort(X.title_words(F.col("title"))), " ").alias("words"), numbers.alias("numbers"))


def _script(x: str, letters: str) -> str:
    return f"length(regexp_replace({x}, '[^{letters}]', '', 'g'))"


_dv, _lt = _script("body", r"\x{0900}-\x{097F}"), _script("body", "a-zA-Z")
_tmixed = words_sql(rf"regexp_replace({norm('title')}, '[\s\p{{Z}}]+[-–—|][\s\p{{Z}}]+[^-–—|]{{2,30}}$', '')", 3, 4)
SQL["deva_keys"] = f"""SELECT doc_id, md5({key("body")}) AS body_key, round(CASE WHEN {_dv} + {_lt} > 0 THEN {_dv}::DOUBLE / ({_dv} + {_lt}) ELSE 0.0 END, 6) AS ratio, regexp_matches(title, '[\\x{{0900}}-\\x{{097F}}]') AS devanagari,
array_to_string(list_sort(CASE WHEN regexp_matches(title, '[\\x{{0900}}-\\x{{097F}}]') THEN list_filter({_tmixed}, lambda w: w NOT IN ({_both})) ELSE {title_sql("title")} END), ' ') AS words, array_to_string({value_order(nums("body"))}, ',') AS numbers FROM ({DEVA_ART})"""


def title_dedup(spark, sf_dir):
    rows = articles(spark, sf_dir).select("doc_id", X.normal_key(F.col("title")).alias("title_key"))
    return A.first_wins(rows, "title_key", ["doc_id"]).select("doc_id", "title_key", F.md5("title_key").alias("dedup_key"))


SQL["title_dedup"] = f"WITH k AS (SELECT doc_id, {key('title')} AS title_key FROM ({ART})) SELECT doc_id, title_key, md5(title_key) AS dedup_key FROM k QUALIFY title_key = '' OR row_number() OVER (PARTITION BY title_key ORDER BY doc_id) = 1"


def title_tokens(spark, sf_dir):
    return articles(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(X.title_words(F.col("title"))), " ").alias("words"))


SQL["title_tokens"] = f"SELECT doc_id, array_to_string(list_sort({title_sql('title')}), ' ') AS words FROM ({ART})"


def url_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", X.url_key(F.col("url")).alias("url_key"), X.short_url(F.col("url")).alias("short_url"))
    return A.first_wins(rows, "url_key", ["page_id"])


_rest = "regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
SQL["url_dedup"] = rf"""WITH r AS (SELECT page_id, url, {_rest} AS rest, regexp_replace(url, '^https?://(www\.)?', '') AS t FROM pages),
q AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_'))) AS query, CASE WHEN contains(t, '?') THEN '?…' ELSE '' END AS suffix, split_part(t, '?', 1) AS base FROM r),
u AS (SELECT *, regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www\.', '') || regexp_replace(regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), ';[^/]*$', ''), '/+$', '') || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END AS url_key, split_part(base, '/', 1) AS host FROM q),
s AS (SELECT *, substr(base, length(host) + 2) AS path, 44 - length(suffix) AS room FROM u)
SELECT page_id, url_key, CASE WHEN length(base) <= room THEN base || suffix WHEN path = '' THEN left(base, room) || '…' ELSE host || '/…' || right(path, greatest(8, room - length(host) - 2)) || suffix END AS short_url FROM s QUALIFY url_key = '' OR row_number() OVER (PARTITION BY url_key ORDER BY page_id) = 1"""

FORMS = ("yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "yyyy/MM/dd", "dd.MM.yyyy", "dd MMM yyyy", "MMMM dd, yyyy", "yyyy-MM-dd'T'HH:mm:ss")
FORMS_SQL = ("%Y-%m-%d", "%d-%m-%Y", "%d/%m/%Y", "%Y/%m/%d", "%d.%m.%Y", "%d %b %Y", "%B %d, %Y", "%Y-%m-%dT%H:%M:%S")


def date_window(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    text = F.lit("no date")
    for i, f in enumerate(FORMS):
        text = F.when(F.col("event_id") % 9 == i, F.date_format("ts", f)).otherwise(text)
    day = rows.select("event_id", text.alias("published")).withColumn("day", X.parsed_date(F.col("published")))
    verdict = X.in_window(F.col("day"), "2024-01-10", "2024-01-20")
    return day.select("event_id", "published", F.col("day").cast("string").alias("day"), verdict.alias("kept"), F.when(verdict, "kept").when(~verdict, "too_old").otherwise("undated").alias("reason"))


_published = "CASE " + " ".join(f"WHEN event_id % 9 = {i} THEN strftime(ts, '{f}')" for i, f in enumerate(FORMS_SQL)) + " ELSE 'no date' END"
SQL["date_window"] = f"""WITH d AS (SELECT event_id, {_published} AS published, CASE WHEN event_id % 9 < 8 THEN CAST(ts AS DATE) END AS day FROM events)
SELECT event_id, published, CAST(day AS VARCHAR) AS day, day BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' AS kept, CASE WHEN day IS NULL THEN 'undated' WHEN day BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' THEN 'kept' ELSE 'too_old' END AS reason FROM d"""


def drop_reasons(spark, sf_dir):
    rows = A.with_tokens(articles(spark, sf_dir), F.concat_ws(" ", "title", "body"))
    rows = rows.withColumn("k", X.normal_key(F.col("title"))).withColumn("off", ~A.relevant(strong=STRONG, weak=WEAK)).withColumn("short", F.length("body") < 300)
    # rows with an empty key are no repeats of one another and need no common window
    rows = rows.withColumn("late", F.row_number().over(Window.partitionBy("k", F.col("short") | F.col("off"), F.when(F.col("k") == "", F.col("doc_id"))).orderBy("doc_id")) > 1)
    reason = F.when(F.col("short"), "short_body").when(F.col("off"), "off_topic").when(F.col("late") & (F.col("k") != ""), "duplicate").otherwise("kept")
    return rows.groupBy(reason.alias("reason"), "source").agg(F.count("*").alias("n"))


SQL["drop_reasons"] = f"""WITH {token_sql(ART, "title || ' ' || body")}, f AS (SELECT *, {key("title")} AS k, NOT (len({hits_sql(STRONG)}) > 0 OR len({hits_sql(WEAK)}) >= 2) AS off, length(body) < 300 AS short FROM t3),
w AS (SELECT *, row_number() OVER (PARTITION BY k, short OR off ORDER BY doc_id) > 1 AS late FROM f)
SELECT CASE WHEN short THEN 'short_body' WHEN off THEN 'off_topic' WHEN late AND k <> '' THEN 'duplicate' ELSE 'kept' END AS reason, source, count(*) AS n FROM w GROUP BY 1, 2"""


def copied_text(spark, sf_dir):
    # grams of hashes meet, not texts
    docs = table(spark, sf_dir, "documents").select("doc_id", X.word_grams(F.col("text")).alias("a"), (F.length("text") < 30).alias("short"))
    story = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"), F.col("short").alias("brief"))
    rows = docs.join(story, "doc_id").withColumn("copied", F.when(F.col("short") | F.col("brief"), 0).otherwise(X.gram_share(F.col("a"), F.col("b"))))
    return rows.select("doc_id", F.col("copied").alias("plagiarism_score"), X.band(F.col("copied"), 20, 35, True).alias("band"))


def grams_sql(x: str) -> str:
    w = rf"regexp_extract_all(lower({x}), '[a-z\x{{0900}}-\x{{097F}}]{{2,}}')"
    return f"list_distinct(list_transform(range(1, len({w}) - 2), lambda i: array_to_string(list_slice({w}, i, i + 3), ' ')))"


SQL["copied_text"] = rf"""WITH w AS (SELECT doc_id, length(body) < 30 OR length(story) < 30 AS short, regexp_extract_all(lower(body), '[a-z\x{{0900}}-\x{{097F}}]{{2,}}') AS a, regexp_extract_all(lower(story), '[a-z\x{{0900}}-\x{{097F}}]{{2,}}') AS b FROM ({PAIR})),
g AS (SELECT doc_id, short, list_distinct(list_transform(range(1, len(a) - 2), lambda i: array_to_string(list_slice(a, i, i + 3), ' '))) AS a, list_distinct(list_transform(range(1, len(b) - 2), lambda i: array_to_string(list_slice(b, i, i + 3), ' '))) AS b FROM w),
c AS (SELECT doc_id, CASE WHEN short OR len(b) = 0 THEN 0 ELSE CAST(round_even(100.0 * len(list_intersect(a, b)) / len(b), 0) AS INT) END AS s FROM g)
SELECT doc_id, s AS plagiarism_score, CASE WHEN s <= 20 THEN 'ok' WHEN s <= 35 THEN 'warn' ELSE 'err' END AS band FROM c"""


def clustered(spark, sf_dir):
    rows = articles(spark, sf_dir).withColumn("w", X.story_key(F.col("title")))
    return rows.join(A.story_components(rows, "doc_id", "w", 0.20).withColumnRenamed("node", "doc_id"), "doc_id")


CLUSTER = f"""WITH RECURSIVE art AS (SELECT *, list_distinct(list_transform({title_sql("title")}, lambda w: {stem("w")})) AS w FROM ({ART})), tok AS (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM art),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM tok a JOIN tok b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) >= 0.20::DOUBLE * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r AS (SELECT doc_id AS node, doc_id AS reach FROM art UNION SELECT r.node, x.b FROM r JOIN both_ways x ON x.a = r.reach), lab AS (SELECT node AS doc_id, min(reach) AS cluster FROM r GROUP BY node), c AS (SELECT * FROM art JOIN lab USING (doc_id))"""


def story_clusters(spark, sf_dir):
    rows = clustered(spark, sf_dir)
    lead = F.max_by("doc_id", F.struct(F.length("body"), -F.col("doc_id")))
    return rows.groupBy("cluster").agg(F.count("*").alias("size"), lead.alias("lead"), F.sum(F.length("body")).alias("chars"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


SQL["story_clusters"] = f"""{CLUSTER} SELECT cluster, count(*) AS size, arg_max(doc_id, length(body) * 1000000000 - doc_id) AS lead, sum(length(body))::BIGINT AS chars, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM c GROUP BY cluster"""


def merged_by_language(spark, sf_dir):
    """Merged bodies of the articles that share a title key (topic-free grouping)."""
    rows = articles(spark, sf_dir).withColumn("k", X.normal_key(F.col("title"))).where("k <> ''")
    out = A.merged_bodies(rows.withColumn("date", F.lit(None).cast("string")), "k", "doc_id", "source", "date", "body")
    return out.select("k", "lead", "cluster_size", "cluster_trimmed", F.md5("body").alias("body_md5"), F.array_join("cluster_sources", ",").alias("sources"), F.md5(F.array_join("cluster_titles", "|")).alias("titles_md5"))


_trim = r"regexp_replace(body, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"
_cut = r"regexp_replace(left(t, CASE WHEN back > 0 AND share - back - 1 > share // 2 THEN share - back - 1 ELSE share END), '[\s\p{Z}]+$', '') || ' […]'"
SQL["merged_by_language"] = f"""WITH k AS (SELECT *, {key("title")} AS k FROM ({ART})), n AS (SELECT *, {_trim} AS t, count(*) OVER (PARTITION BY k) AS n FROM k WHERE k <> ''), s AS (SELECT *, greatest(400, (6000 - n * 60) // n) AS share FROM n),
b AS (SELECT *, instr(reverse(left(t, share)), chr(10) || chr(10)) AS back FROM s),
p AS (SELECT *, CASE WHEN n = 1 THEN body ELSE '[' || source || ' — no date]' || chr(10) || CASE WHEN length(t) > share THEN {_cut} ELSE t END END AS part, CASE WHEN n > 1 AND length(t) > share THEN 1 ELSE 0 END AS trimmed, row_number() OVER (PARTITION BY k ORDER BY length(body) DESC, doc_id) AS r FROM b)
SELECT k, max(doc_id) FILTER (r = 1) AS lead, CAST(count(*) AS INT) AS cluster_size, CAST(sum(trimmed) AS INT) AS cluster_trimmed, md5(string_agg(part, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY r)) AS body_md5, string_agg(source, ',' ORDER BY r) AS sources, md5(string_agg(title, '|' ORDER BY r)) AS titles_md5 FROM p GROUP BY k"""


def source_report(spark, sf_dir):
    return ST.body_report(articles(spark, sf_dir), ["source"], "body", "lang")


SQL["source_report"] = f"SELECT source, count(*) AS articles, min(length(body)) AS shortest, list_sort(list(length(body)))[count(*) // 2 + 1] AS upper_median, max(length(body)) AS longest, count(*) FILTER (length(body) < 300) AS short, count(DISTINCT lang) AS langs, round_even(avg(length(body)), 1) AS mean_chars FROM ({ART}) GROUP BY source"


def browse_rows(spark, sf_dir):
    rows = articles(spark, sf_dir)
    return rows.select("doc_id", X.snippet(F.col("body")).alias("snippet"), X.short_source(F.col("source")).alias("short_source"), (F.length("body") < 300).alias("short"), X.article_key(F.lit(None).cast("string"), F.col("title"), F.col("source"), F.lit("")).alias("article_key"))


_snip = rf"trim(regexp_replace(body, '{W}', ' ', 'g'))"
SQL["browse_rows"] = rf"""SELECT doc_id, left({_snip}, 170) || CASE WHEN length({_snip}) > 170 THEN '…' ELSE '' END AS snippet, source AS short_source, length(body) < 300 AS short,
sha256('["fields", "' || replace(replace(title, '\', '\\'), '"', '\"') || '", "' || replace(replace(source, '\', '\\'), '"', '\"') || '", ""]') AS article_key FROM ({ART})"""


def selection(spark, sf_dir):
    """Articles left after excluding keys; keys of documents that labels call low quality are excluded, stale keys are pruned."""
    rows = articles(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id").unionByName(spark.range(1).select((F.col("id") - 5).alias("doc_id")))
    excluded = labels.join(rows.select("doc_id"), "doc_id", "left_semi")
    left = rows.join(excluded, "doc_id", "left_anti")
    total = rows.groupBy("source").agg(F.count("*").alias("total"))
    return total.join(left.groupBy("source").agg(F.count("*").alias("selected")), "source", "left").select("source", "total", F.coalesce("selected", F.lit(0).cast("long")).alias("selected"), (F.col("total") - F.coalesce("selected", F.lit(0))).alias("excluded"))


SQL["selection"] = "WITH x AS (SELECT doc_id FROM labels WHERE quality = 0) SELECT source, count(*) AS total, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM x)) AS selected, count(*) FILTER (doc_id IN (SELECT doc_id FROM x)) AS excluded FROM documents GROUP BY source"


def resume_estimate(spark, sf_dir):
    """Title groups still to write: those whose resume key no written story has (documents with even ids stand for written ones)."""
    rows = articles(spark, sf_dir).withColumn("k", F.trim(F.regexp_replace(F.lower("title"), X.WHITE, " ")))
    written = rows.where("doc_id % 2 = 0").select("k").distinct()
    marked = rows.select("k").distinct().join(written.withColumn("done", F.lit(True)), "k", "left")
    return marked.agg(F.count("*").alias("groups"), F.count_if(F.col("done").isNull()).alias("calls"), F.count_if(F.col("done")).alias("skipped"))


SQL["resume_estimate"] = rf"WITH k AS (SELECT doc_id, trim(regexp_replace(lower(title), '{W}', ' ', 'g')) AS k FROM ({ART})), g AS (SELECT k, bool_or(doc_id % 2 = 0) AS done FROM k GROUP BY k) SELECT count(*) AS groups, count(*) FILTER (NOT done) AS calls, count(*) FILTER (done) AS skipped FROM g"


def source_caps(spark, sf_dir):
    return A.capped(articles(spark, sf_dir).where(F.length("body") >= 300), "source", ["doc_id"], 5).select("source", "doc_id")


SQL["source_caps"] = f"SELECT source, doc_id FROM ({ART}) WHERE length(body) >= 300 QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5"


def search_plan(spark, sf_dir):
    """Every keyword with every engine, in order."""
    words = spark.createDataFrame([(0, "rail"), (1, "metro"), (2, "port")], "k int, keyword string")
    engines = spark.createDataFrame([(0, "news"), (1, "rss")], "e int, engine string")
    return words.crossJoin(engines).select((F.col("k") * 2 + F.col("e")).alias("ord"), "keyword", "engine")


SQL["search_plan"] = "SELECT k * 2 + e AS ord, keyword, engine FROM (VALUES (0, 'rail'), (1, 'metro'), (2, 'port')) a(k, keyword) CROSS JOIN (VALUES (0, 'news'), (1, 'rss')) b(e, engine)"


def run_compare(spark, sf_dir):
    """Metrics of two runs (halves of January) side by side, full outer on the event type."""
    rows = table(spark, sf_dir, "events")
    sums = lambda cond, name: rows.where(cond).groupBy("event_type").agg(F.count("*").alias(f"n_{name}"), F.countDistinct("user_id").alias(f"users_{name}"))
    out = sums("ts < '2024-01-15'", "a").join(sums("ts >= '2024-01-15' and value > 50", "b"), "event_type", "full_outer")
    return out.select("event_type", "n_a", "n_b", "users_a", "users_b", (~F.col("n_a").eqNullSafe(F.col("n_b"))).alias("changed"))


SQL["run_compare"] = """WITH a AS (SELECT event_type, count(*) AS n_a, count(DISTINCT user_id) AS users_a FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1), b AS (SELECT event_type, count(*) AS n_b, count(DISTINCT user_id) AS users_b FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND value > 50 GROUP BY 1)
SELECT event_type, n_a, n_b, users_a, users_b, n_a IS DISTINCT FROM n_b AS changed FROM a FULL JOIN b USING (event_type)"""


def page_paragraphs(spark, sf_dir):
    """Paragraphs of 30 characters or more by the regular contract <p[^>]*>([^<]*), tags stripped, and the h1 title."""
    rows = table(spark, sf_dir, "pages")
    parts = F.filter(F.transform(F.regexp_extract_all("html", F.lit("<p[^>]*>([^<]*)"), F.lit(1)), lambda p: F.trim(F.regexp_replace(p, X.WHITE, " "))), lambda p: F.length(p) >= 30)
    return rows.select("page_id", F.size(parts).alias("n"), F.md5(F.array_join(parts, "\n\n")).alias("body_md5"), F.regexp_extract("html", "<h1[^>]*>([^<]*)", 1).alias("title"), F.size(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"#]*)'), F.lit(1)))).alias("links"))


_par = rf"list_filter(list_transform(regexp_extract_all(html, '<p[^>]*>([^<]*)', 1), lambda p: trim(regexp_replace(p, '{W}', ' ', 'g'))), lambda p: length(p) >= 30)"
SQL["page_paragraphs"] = f"""SELECT page_id, CAST(len({_par}) AS INT) AS n, md5(array_to_string({_par}, chr(10) || chr(10))) AS body_md5, regexp_extract(html, '<h1[^>]*>([^<]*)', 1) AS title, CAST(len(list_distinct(regexp_extract_all(html, 'href="([^"#]*)', 1))) AS INT) AS links FROM pages"""


def bilingual_scores(spark, sf_dir):
    """Turns stand for sources, the next turns for their stories and the ones after for translations; even conversations claim Hindi, others English, every seventh nothing."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("body"))
    later = lambda k, name: turns.select("conv_id", (F.col("turn") - k).alias("turn"), F.col("body").alias(name))
    rows = turns.join(later(1, "ai_news_story"), ["conv_id", "turn"], "left").join(later(2, "ai_news_story_translated"), ["conv_id", "turn"], "left")
    lang = F.when(F.col("conv_id") % 7 == 0, "unknown").when(F.col("conv_id") % 2 == 0, "hi").otherwise("en")
    rows = rows.withColumns({"source_lang": lang, "title": F.lit("")})
    return ST.bilingual_scores(rows).select("conv_id", "turn", "bilingual_score", "hindi_information_score")


SQL["bilingual_scores"] = r"""WITH p AS (SELECT a.conv_id, a.turn, CASE WHEN a.conv_id % 7 = 0 THEN 'unknown' WHEN a.conv_id % 2 = 0 THEN 'hi' ELSE 'en' END AS lang, coalesce(a.text, '') AS body, coalesce(b.text, '') AS story, coalesce(c.text, '') AS other
FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 LEFT JOIN conversations c ON a.conv_id = c.conv_id AND c.turn = a.turn + 2),
f AS (SELECT *, regexp_matches(body, '[\x{0900}-\x{097F}]') AS bh, regexp_matches(story, '[\x{0900}-\x{097F}]') AS sh, regexp_matches(other, '[\x{0900}-\x{097F}]') AS oh, regexp_matches(story, '[A-Za-z]') AS se, regexp_matches(other, '[A-Za-z]') AS oe FROM p)
SELECT conv_id, turn, CAST((CASE WHEN lang IN ('hi', 'en') THEN 25 ELSE 0 END) + (CASE WHEN length(regexp_replace(story, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) > 30 THEN 25 ELSE 0 END) + (CASE WHEN length(regexp_replace(other, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) > 30 THEN 25 ELSE 0 END)
+ (CASE WHEN lang = 'hi' AND sh AND oe OR lang = 'en' AND se AND oh THEN 25 ELSE 0 END) AS INT) AS bilingual_score, CAST((CASE WHEN bh THEN 35 ELSE 0 END) + (CASE WHEN sh THEN 35 ELSE 0 END) + (CASE WHEN oh THEN 30 ELSE 0 END) AS INT) AS hindi_information_score FROM f"""


def json_props(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("m", F.from_json("props", "map<string,bigint>"))
    return rows.groupBy("event_type").agg(F.sum(F.element_at("m", "k")).alias("k_sum"), F.max(F.col("ts").cast("string")).alias("newest"))


SQL["json_props"] = "SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k_sum, CAST(max(ts) AS VARCHAR) AS newest FROM events GROUP BY event_type"

NAMES = ("deva_terms", "deva_keys", "number_coverage", "grounding_gates", "bi_script_terms", "bi_script_keys", "title_dedup", "title_tokens", "url_dedup", "date_window", "drop_reasons", "copied_text", "story_clusters", "merged_by_language", "source_report", "browse_rows", "selection", "resume_estimate", "source_caps", "search_plan", "run_compare", "page_paragraphs", "bilingual_scores", "json_props")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: globals()[n] for n in NAMES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
