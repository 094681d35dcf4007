"""Queries of sources, review and reports over the test tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from akshara.functions import text as X
from akshara.functions.topics import TOPICS
from akshara.operators import articles as A
from akshara.operators import lexicon as LX
from akshara.operators import review as R
from akshara.plans import queries as Q
from akshara.sources import search as S
from akshara.streaming import articles as ST

#: Topics for the generated English texts.
PLAIN_TOPICS = {"fruit": ("apple", "thion"), "motion": ("oning", "erthe on"), "article": ("theand", "and the", "theanther")}
SQL: dict[str, str] = {}


def evidence_sql(topics) -> str:
    return "list_filter([" + ", ".join(f"{{'topic': '{t}', 'hits': {Q.hits_sql(terms)}}}" for t, terms in topics.items()) + "], lambda x: len(x.hits) > 0)"


def derived_topics(spark, sf_dir):
    rows = A.with_tokens(Q.articles(spark, sf_dir), F.concat_ws(" ", "title", "body"))
    return rows.select("doc_id", F.array_join(R.derived_topics(3, PLAIN_TOPICS), ",").alias("topics"))


SQL["derived_topics"] = f"""WITH {Q.token_sql(Q.ART, "title || ' ' || body")} SELECT doc_id, array_to_string(list_transform(list_slice(list_sort(list_transform({evidence_sql(PLAIN_TOPICS)}, lambda x: {{'n': -len(x.hits), 'topic': x.topic}})), 1, 3), lambda x: x.topic), ',') AS topics FROM t3"""

CLAIMED = ("Safety", "Operations", "New-Trains", "Weather")


def verified_topics(spark, sf_dir):
    rows = A.with_tokens(Q.fixture(spark), F.col("text")).withColumn("claimed", F.lit(list(CLAIMED)))
    out = R.verified_topics(rows, "claimed")
    joined = {c: F.array_join(c, ",").alias(c) for c in ("topics_verified", "topics_unsupported", "topics_off_vocabulary")}
    return out.select("id", *joined.values(), F.array_join(F.element_at("topic_evidence", "Safety"), ",").alias("safety_evidence"))


_claimed = "[" + ", ".join(f"'{t}'" for t in CLAIMED) + "]"
_known = "[" + ", ".join(f"'{t}'" for t in TOPICS) + "]"
SQL["verified_topics"] = f"""WITH {Q.token_sql(Q.VALUES, "text")}, e AS (SELECT id, list_transform({evidence_sql(TOPICS)}, lambda x: x.topic) AS named, {Q.hits_sql(TOPICS["Safety"])} AS safety FROM t3)
SELECT id, array_to_string(list_filter({_claimed}, lambda t: list_contains(named, t)), ',') AS topics_verified, array_to_string(list_filter({_claimed}, lambda t: list_contains({_known}, t) AND NOT list_contains(named, t)), ',') AS topics_unsupported,
array_to_string(list_filter({_claimed}, lambda t: NOT list_contains({_known}, t)), ',') AS topics_off_vocabulary, CASE WHEN len(safety) > 0 THEN array_to_string(list_slice(safety, 1, 4), ',') END AS safety_evidence FROM e"""


def topic_buckets(spark, sf_dir):
    """Articles grouped by their first topic."""
    rows = A.with_tokens(Q.articles(spark, sf_dir), F.concat_ws(" ", "title", "body"))
    first = F.coalesce(F.get(R.derived_topics(1, PLAIN_TOPICS), F.lit(0)), F.lit("Unclassified"))
    return rows.groupBy(first.alias("topic")).agg(F.count("*").alias("size"), F.sum(F.length("body")).alias("chars"), F.max_by("doc_id", F.struct(F.length("body"), -F.col("doc_id"))).alias("lead"))


SQL["topic_buckets"] = f"""WITH {Q.token_sql(Q.ART, "title || ' ' || body")}, b AS (SELECT *, coalesce(list_sort(list_transform({evidence_sql(PLAIN_TOPICS)}, lambda x: {{'n': -len(x.hits), 'topic': x.topic}}))[1].topic, 'Unclassified') AS topic FROM t3)
SELECT topic, count(*) AS size, sum(length(body))::BIGINT AS chars, arg_max(doc_id, length(body) * 1000000000 - doc_id) AS lead FROM b GROUP BY topic"""


def same_story(spark, sf_dir):
    """For each article the five others of the likest titles, with score, source, title and length, and how many there are in all."""
    rows = Q.articles(spark, sf_dir).withColumn("w", X.title_words(F.col("title")))
    found = A.same_story(rows, "doc_id", "w", 0.45, 5)
    named = rows.select(F.col("doc_id").alias("other"), "source", "title", F.length("body").alias("chars"))
    return found.join(named, "other").select(F.col("i").alias("doc_id"), "others", "place", "other", F.bround("score", 2).alias("score"), "source", "title", "chars")


SQL["same_story"] = f"""WITH a AS (SELECT *, {Q.title_sql("title")} AS w FROM ({Q.ART})), tok AS (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM a), e AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) / (a.n + b.n - count(*))::DOUBLE AS score FROM tok a JOIN tok b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) >= 0.45::DOUBLE * (a.n + b.n - count(*))),
r AS (SELECT *, count(*) OVER (PARTITION BY a) AS others, CAST(row_number() OVER (PARTITION BY a ORDER BY score DESC, b) - 1 AS INT) AS place FROM e)
SELECT r.a AS doc_id, others, place, r.b AS other, round_even(score, 2) AS score, source, title, CAST(length(body) AS INT) AS chars FROM r JOIN a ON a.doc_id = r.b WHERE place < 5"""


def listing_links(spark, sf_dir):
    rows = S.listing_links(Q.table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return rows.groupBy("page_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "link"))), lambda x: x["link"]), " ").alias("links"))


def host_sql(x: str) -> str:
    return rf"regexp_replace(lower(regexp_extract(coalesce({x}, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '')"


def _host(x: str) -> str:
    return f"replace(regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), 'www.', '')"


SQL["listing_links"] = rf"""WITH p AS (SELECT page_id, url, regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1) AS f FROM pages),
l AS (SELECT page_id, url, replace(trim(unnest(f)), '&amp;', '&') AS h, generate_subscripts(f, 1) AS ord FROM p),
a AS (SELECT page_id, url, ord, CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h WHEN starts_with(h, '//') THEN regexp_extract(url, '^([A-Za-z]+:)', 1) || h WHEN starts_with(h, '/') THEN regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || h
WHEN starts_with(h, '#') OR h = '' THEN regexp_replace(url, '#.*$', '') || h WHEN starts_with(h, '?') THEN regexp_replace(url, '[?#].*$', '') || h ELSE regexp_replace(regexp_extract(url, '^[^?#]*', 0), '/[^/]*$', '') || '/' || h END AS link FROM l),
d AS (SELECT page_id, regexp_replace(link, '#.*$', '') AS link, min(ord) AS ord FROM a WHERE contains({_host("link")}, {_host("url")}) AND NOT regexp_matches(link, '{S.SKIP_LINK}') GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS n FROM d)
SELECT page_id, count(*) AS n, string_agg(link, ' ' ORDER BY ord) AS links FROM r WHERE n <= 25 GROUP BY page_id"""

BLOCKED = ("example.com", "net")


def page_hosts(spark, sf_dir):
    rows = Q.table(spark, sf_dir, "pages")
    return rows.groupBy(S.host_of(F.col("url")).alias("host"), S.blocked(F.col("url"), BLOCKED).alias("blocked")).agg(F.count("*").alias("n"))


_blocked = " OR ".join(f"host = '{d}' OR ends_with(host, '.{d}')" for d in BLOCKED)
SQL["page_hosts"] = f"SELECT host, {_blocked} AS blocked, count(*) AS n FROM (SELECT {host_sql('url')} AS host FROM pages) GROUP BY ALL"


def freshness(spark, sf_dir):
    days = F.pmod("event_id", F.lit(101)).cast("int")
    return Q.table(spark, sf_dir, "events").groupBy(S.freshness(days).alias("period")).agg(F.count("*").alias("n"))


SQL["freshness"] = "SELECT CASE WHEN d <= 0 THEN NULL WHEN d <= 1 THEN 'pd' WHEN d <= 7 THEN 'pw' WHEN d <= 31 THEN 'pm' ELSE 'py' END AS period, count(*) AS n FROM (SELECT event_id % 101 AS d FROM events) GROUP BY 1"


def article_search(spark, sf_dir):
    """Articles whose title, snippet or source holds a text, whatever the case."""
    holds = [F.contains(F.lower(c), F.lit("eriner")) for c in (F.col("title"), X.snippet(F.col("body")), F.col("source"))]
    return Q.articles(spark, sf_dir).where(holds[0] | holds[1] | holds[2]).select("doc_id", "title")


SQL["article_search"] = f"SELECT doc_id, title FROM ({Q.ART}) WHERE contains(lower(title), 'eriner') OR contains(lower(left({Q._snip}, 170) || CASE WHEN length({Q._snip}) > 170 THEN '…' ELSE '' END), 'eriner') OR contains(lower(source), 'eriner')"


def score_report(spark, sf_dir):
    """Distinct values and range of each metric, and how many lack it."""
    rows = A.coverage(Q.pairs(spark, sf_dir), "body", "story").withColumn("plagiarism_score", X.copied_share(F.col("body"), F.col("story")))
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("int").alias("value")) for c in ("coverage_score", "number_precision", "plagiarism_score")])))
    return long.groupBy("metric").agg(F.countDistinct("value").alias("values"), F.min("value").alias("least"), F.max("value").alias("most"), F.count_if(F.col("value").isNull()).alias("missing"))


SQL["score_report"] = f"""{Q.COVERAGE}, m AS (SELECT 'coverage_score' AS metric, coverage_score AS value FROM s UNION ALL SELECT 'number_precision', number_precision FROM s UNION ALL SELECT 'plagiarism_score', plagiarism_score FROM ({Q.SQL["copied_text"]}))
SELECT metric, count(DISTINCT value) AS "values", min(value) AS least, max(value) AS most, count(*) FILTER (value IS NULL) AS missing FROM m GROUP BY metric"""


def gate_listing(spark, sf_dir):
    """How often each gate fails."""
    rows = Q.gated(spark, sf_dir)
    return rows.select(F.explode("gate_failures").alias("f")).groupBy(F.regexp_replace("f", "[0-9]+", "N").alias("gate")).agg(F.count("*").alias("n"))


SQL["gate_listing"] = f"""SELECT gate, count(*) AS n FROM (SELECT regexp_replace(unnest(string_split(gate_failures, '; ')), '[0-9]+', 'N', 'g') AS gate FROM ({Q.SQL["grounding_gates"]}) WHERE gate_failures <> '') GROUP BY gate"""


def impact_table(spark, sf_dir):
    """Impact by the rule against a claimed level, and how often they agree."""
    rows = A.impact(A.with_tokens(Q.fixture(spark), F.col("text")), F.lit("Medium"))
    return rows.groupBy("impact_rule_level").agg(F.count("*").alias("n"), F.count_if("impact_agrees").alias("agree"))


SQL["impact_table"] = f"SELECT impact_rule_level, count(*) AS n, count(*) FILTER (impact_rule_level = 'Medium') AS agree FROM ({Q.SQL['bi_script_terms']}) GROUP BY 1"


def text_languages(spark, sf_dir):
    rows = Q.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang").unionByName(Q.fixture(spark).select((-F.col("id").cast("long")).alias("id"), "text", F.lit("").alias("lang")))
    return rows.select("id", R.text_language(F.col("text"), F.col("lang")).alias("language"))


SQL["text_languages"] = f"WITH r AS (SELECT doc_id AS id, text, lang FROM documents UNION ALL SELECT -id, text, '' FROM ({Q.VALUES})), c AS (SELECT *, {Q._deva} AS hi, {Q._latin} AS en FROM r) SELECT id, CASE WHEN coalesce(hi + en, 0) = 0 THEN lang WHEN hi >= en THEN 'hi' ELSE 'en' END AS language FROM c"


def newest_of_each(spark, sf_dir):
    """The newest event of each type with its id, of equal times the smallest."""
    rows = Q.table(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("ts"), "event_id"))
    return rows.withColumn("n", n).where("n = 1").select("event_type", "event_id", F.col("ts").cast("string").alias("ts"))


SQL["newest_of_each"] = "SELECT event_type, event_id, CAST(ts AS VARCHAR) AS ts FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) = 1"


def runs_by_day(spark, sf_dir):
    """Events stand for runs: per day how many, by how many users, and which kinds."""
    rows = Q.table(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("day"))
    return rows.agg(F.count("*").alias("runs"), F.countDistinct("user_id").alias("users"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


SQL["runs_by_day"] = "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS runs, count(DISTINCT user_id) AS users, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds FROM events GROUP BY 1"

LINES = [(9, "AI generating 2/7: a title"), (10, "=== a === b ==="), (11, "  OK WARNING"), (1, "=== Daily News ==="), (2, "  OK   title"), (3, "  skip (short body) x"), (4, "WARNING: none"), (5, "Wrote 3 articles"), (6, "=== NR — North ==="), (7, "  OK y"), (8, "Traceback (most recent call last)")]


def log_progress(spark, sf_dir):
    lines = spark.createDataFrame([(f"run-{i % 2}", t) for i, t in LINES], "log_name string, line string")
    return ST.progress(lines)


_lines = ", ".join(f"('run-{i % 2}', '{t}')" for i, t in LINES)
SQL["log_progress"] = rf"""SELECT log_name, CASE WHEN regexp_matches(line, '^AI generating [0-9]+/[0-9]+: ') THEN 'generating' WHEN regexp_matches(line, '^=== .+? ===$') THEN 'source' WHEN regexp_matches(line, '^\s+OK\s') THEN 'kept' WHEN regexp_matches(line, '^\s+skip \(.+?\)') THEN 'skipped' WHEN regexp_matches(line, 'WARNING|FAILED|Traceback') THEN 'warning' WHEN regexp_matches(line, '^Wrote [0-9]+ article') THEN 'wrote' ELSE 'other' END AS kind, count(*) AS n FROM (VALUES {_lines}) v(log_name, line) GROUP BY 1, 2"""


def hourly_counts(spark, sf_dir):
    """An extension: events of each type per hour, the batch form of the streaming counts."""
    rows = Q.table(spark, sf_dir, "events").groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type")
    return rows.agg(F.count("*").alias("n"))


SQL["hourly_counts"] = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2"

def lexicon_terms(spark, sf_dir):
    """Documents that hold terms of a list of all words of four letters or more and all pairs of neighbouring ones of the benchmark: how many, and which."""
    runs = Q.table(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]{4,}"), F.lit(0)).alias("w"))
    pairs = F.transform(F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: i < F.size("w")), lambda i: F.concat_ws(" ", F.get("w", i - 1), F.get("w", i)))
    terms = runs.where(F.size("w") > 0).select(F.explode(F.concat("w", pairs)).alias("term")).distinct().withColumn("list", F.when(F.contains("term", F.lit(" ")), "pairs").otherwise("words"))
    docs = Q.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = LX.lexicon_hits(docs, "doc_id", F.col("text"), terms)
    return found.groupBy(F.col("idx").alias("doc_id"), "list").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("term")), ",")).alias("terms_md5"))


SQL["lexicon_terms"] = f"""WITH r AS (SELECT regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{4,}}') AS w FROM benchmark), l AS (SELECT DISTINCT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM r),
{Q.token_sql("SELECT doc_id, text FROM documents", "text")}, h AS (SELECT doc_id, 'pairs' AS list, term FROM t3 JOIN l ON contains(blob, term) WHERE contains(term, ' ') UNION ALL SELECT doc_id, 'words', term FROM (SELECT doc_id, unnest(words) AS word FROM t3) JOIN l ON word = term)
SELECT doc_id, list, count(*) AS n, md5(string_agg(term, ',' ORDER BY term)) AS terms_md5 FROM h GROUP BY 1, 2"""

NAMES = ("lexicon_terms", "derived_topics", "verified_topics", "topic_buckets", "same_story", "listing_links", "page_hosts", "freshness", "article_search", "score_report", "gate_listing", "impact_table", "text_languages", "newest_of_each", "runs_by_day", "log_progress", "hourly_counts")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: globals()[n] for n in NAMES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
