"""Stored responses of search engines, and hits read from them.

A store is a Parquet folder by engine and keyword: response (its id), status,
listing_url, body, and what the days of its results say: newest, and whether a
result is undated. A run's engines and keywords prune folders, its window
prunes responses in the scan; results are parsed of what is left alone. A
response of another status than 200, or that is no answer of its engine, gives
no hits but an error; nothing raises for it.

Null bodies are no answers; results of equal address are all returned (dedup is
the chain's work); an empty store, or one without a run's engines, holds no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from akshara.operators import crawl as C
from akshara.sources import search as S

#: Engines by the form of their answers.
FEEDS, RESULTS = ("bing",), ("brave",)
ITEM, SENT = "(?s)<item>(.*?)</item>", "(?s)<pubDate>.*?([0-9]{1,2} [A-Z][a-z]{2} [0-9]{4})"
KEY = ["engine", "keyword", "response"]
HIT = ["url", "title", "source", "date", "snippet", "listing_url"]


def results_of(body: Column) -> Column:
    """The array of results in an engine's JSON answer, as JSON; null where the answer is none."""
    return F.when(F.try_parse_json(body).isNotNull(), F.coalesce(F.get_json_object(body, "$.results"), F.lit("[]")))


def days_of(engine: Column, body: Column) -> Column:
    """The day of each result of an answer, null for undated ones."""
    sent = lambda item: F.try_to_date(F.regexp_extract(item, SENT, 1), "d MMM yyyy")
    feed = F.transform(F.regexp_extract_all(body, F.lit(ITEM), F.lit(1)), sent)
    found = F.from_json(results_of(body), "array<struct<page_age: string>>")
    return F.when(engine.isin(*FEEDS), feed).otherwise(F.transform(found, lambda r: F.try_to_date(F.left(r["page_age"], F.lit(10)), "yyyy-MM-dd")))


def save_responses(df: DataFrame, path: str, mode: str = "append") -> None:
    """Adds responses (engine, keyword, response, status, listing_url, body) to a store; files hold one engine's and keyword's each."""
    C.check_engines([r.engine for r in df.select("engine").distinct().limit(len(FEEDS + RESULTS) + 1).collect()], FEEDS + RESULTS)
    days = days_of(F.col("engine"), F.coalesce("body", F.lit("")))
    rows = df.select(*KEY, "status", "listing_url", "body", days.alias("days"))
    rows = rows.select(*KEY, "status", "listing_url", "body", F.array_max("days").alias("newest"), F.coalesce(F.exists("days", lambda d: d.isNull()), F.lit(True)).alias("undated"))
    rows.write.mode(mode).partitionBy("engine", "keyword").parquet(path)


def stored(spark: SparkSession, path: str, keywords: list[str] | None = None, engines: list[str] | None = None, since: str | None = None) -> DataFrame:
    """Responses of the keywords and engines (all) that may hold a result of the day since or later, or one of no day."""
    rows = spark.read.schema("response string, status int, listing_url string, body string, newest date, undated boolean, engine string, keyword string").parquet(path)
    if engines is not None:
        rows = rows.where(F.col("engine").isin(*C.check_engines(engines, FEEDS + RESULTS)))
    if keywords is not None:
        rows = rows.where(F.col("keyword").isin(*keywords))
    if since is not None:
        rows = rows.where((F.col("newest") >= F.lit(since).cast("date")) | F.col("undated"))
    return rows


def error_of() -> Column:
    """Why a response holds no hits, null where it is an answer."""
    body = F.coalesce("body", F.lit(""))
    short = F.regexp_replace(F.left(body, F.lit(120)), "\n", " ")
    status = F.col("status").cast("string")
    feed = F.when(F.col("status") != 200, F.concat(F.lit("HTTP "), status)).when(~F.contains(F.left(body, F.lit(500)), F.lit("<rss")) & ~body.rlike("(?s)<item>.*?</item>"), "response was not an RSS feed")
    found = F.when(F.col("status") != 200, F.concat(F.lit("HTTP "), status, F.lit(": "), short)).when(results_of(body).isNull(), "response was not JSON")
    return F.when(F.col("engine").isin(*FEEDS), feed).otherwise(found)


def engine_hits(spark: SparkSession, path: str, keywords: list[str] | None = None, engines: list[str] | None = None, since: str | None = None, count: int | None = None) -> DataFrame:
    """engine, keyword, response, ord (among the response's hits, from 0), and a hit's fields: the first count hits of each response, of these the ones not known to be from before since."""
    rows = stored(spark, path, keywords, engines, since).where(error_of().isNull())
    packed = F.to_json(F.struct("keyword", "response"))
    parts = []
    for name in FEEDS:
        own = rows.where(F.col("engine") == name).select(packed.alias("key"), "listing_url", "body")
        parts.append(S.rss_hits(own, "body", "key", "listing_url", name))
    for name in RESULTS:
        own = rows.where(F.col("engine") == name).select(packed.alias("key"), "listing_url", results_of(F.col("body")).alias("results"))
        parts.append(S.json_hits(own, "results", "key", "listing_url", name))
    hits = parts[0]
    for more in parts[1:]:
        hits = hits.unionByName(more)
    # a response's hits alone are ranked
    hits = hits.withColumn("ord", F.row_number().over(Window.partitionBy("engine", "query").orderBy("ord")) - 1)
    if count is not None:
        hits = hits.where(F.col("ord") < count)
    if since is not None:
        hits = hits.where((F.col("date") >= since) | (F.col("date") == ""))
    key = F.from_json("query", "keyword string, response string")
    return hits.withColumn("k", key).select("engine", "k.keyword", "k.response", "ord", *HIT)


def response_errors(spark: SparkSession, path: str, keywords: list[str] | None = None, engines: list[str] | None = None) -> DataFrame:
    """engine, keyword, response and error of the responses that are no answers."""
    rows = stored(spark, path, keywords, engines).withColumn("error", error_of())
    return rows.where(F.col("error").isNotNull()).select(*KEY, "error")
