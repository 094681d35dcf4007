"""Parsers of search results and listing pages: what a fetch returned in, rows out. Fetching itself is not part of the engine."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from akshara.functions import text as X

# They must be these for equal results.
SKIP_DOMAINS = ("msn.com", "news.google.com", "bing.com", "youtube.com", "facebook.com", "instagram.com", "x.com", "twitter.com", "wikipedia.org")
SKIP_LINK = r"(?i)/tags?/|/topic/|/about/|articlelist|/photo|/video|/live|/web-stories|/author/|/search|/rss|\.rss|/podcast|#"

RESULT = "array<struct<title: string, url: string, description: string, page_age: string, meta_url: struct<hostname: string>>>"


@F.pandas_udf(T.StringType())
def unescaped(text: pd.Series) -> pd.Series:
    return text.map(lambda x: x if x is None or "&" not in x else html.unescape(x))


def host_of(url: Column) -> Column:
    """Lower-case host and port without www., empty without ://."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")


def blocked(url: Column, domains=SKIP_DOMAINS) -> Column:
    """Whether the host is a listed domain or below one."""
    host = host_of(url)
    return F.exists(F.lit(list(domains)), lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d)))


def freshness(days: Column) -> Column:
    """The shortest period a search service offers that covers so many days, null for none."""
    return F.when(days.isNull() | (days <= 0), None).when(days <= 1, "pd").when(days <= 7, "pw").when(days <= 31, "pm").otherwise("py")


def real_url(link: Column) -> Column:
    """The decoded url parameter of a click-through link, else the link."""
    plain = F.trim(link)
    target = F.try_url_decode(F.regexp_extract(plain, r"\?(?:[^#]*&)?url=([^&#]+)", 1))
    return F.when(F.coalesce(target, F.lit("")) != "", target).otherwise(plain)


def rss_hits(df: DataFrame, xml: str, query: str, listing: str, engine: str) -> DataFrame:
    """One row per item of each feed whose link starts with http: ord (from 0) and the eight fields of a hit."""

    def tag(name: str) -> Column:
        raw = F.trim(F.regexp_extract("item", f"(?s)<{name}>(.*?)</{name}>", 1))
        return F.trim(unescaped(F.regexp_replace(raw, r"(?s)^<!\[CDATA\[(.*)\]\]>$", "$1")))

    items = df.select(F.col(query).alias("query"), F.col(listing).alias("listing_url"), F.posexplode(F.regexp_extract_all(F.coalesce(F.col(xml), F.lit("")), F.lit("(?s)<item>(.*?)</item>"), F.lit(1))).alias("ord", "item"))
    rows = items.withColumns({"url": real_url(tag("link")), "title": tag("title"), "named": tag("News:Source"), "snippet": tag("description"), "sent": tag("pubDate")})
    day = F.try_to_date(F.regexp_extract("sent", "([0-9]{1,2} [A-Z][a-z]{2} [0-9]{4})", 1), "d MMM yyyy")
    source = F.coalesce(F.nullif(F.col("named"), F.lit("")), host_of(F.col("url")))
    return rows.where(F.col("url").startswith("http")).select("ord", "url", "title", source.alias("source"), F.coalesce(day.cast("string"), F.lit("")).alias("date"), "snippet", F.lit(engine).alias("engine"), "query", "listing_url")


def json_hits(df: DataFrame, results: str, query: str, listing: str, engine: str) -> DataFrame:
    """One row per result with a url of each JSON array: ord (from 0) and the eight fields of a hit."""
    items = df.select(F.col(query).alias("query"), F.col(listing).alias("listing_url"), F.posexplode(F.from_json(results, RESULT)).alias("ord", "r"))
    none = F.lit("")
    source = F.regexp_replace(F.coalesce(F.nullif(F.col("r.meta_url.hostname"), none), host_of(F.col("r.url"))), r"^www\.", "")
    rows = items.where(F.coalesce("r.url", none) != "")
    return rows.select("ord", F.col("r.url").alias("url"), F.trim(unescaped(F.coalesce("r.title", none))).alias("title"), source.alias("source"), F.left(F.coalesce("r.page_age", none), F.lit(10)).alias("date"), unescaped(F.regexp_replace(F.coalesce("r.description", none), "<[^>]+>", "")).alias("snippet"), F.lit(engine).alias("engine"), "query", "listing_url")


# They must be these for equal results.
LINK_PATTERNS = {
    "aajtak.in": r"/story/",
    "jansatta.com": r"/\d{6,}/?$",
    "navbharattimes.indiatimes.com": r"articleshow",
    "amarujala.com": r"\d{4}-\d{2}-\d{2}$",
    "livehindustan.com": r"/story-",
    "pib.gov.in": r"PressRelease\w*\.aspx\?PRID=\d+",
}


def domain_key(url: Column, domains=tuple(LINK_PATTERNS)) -> Column:
    """The first listed domain that the host holds or that holds the host, else the host; an empty host matches the first."""
    host = F.replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit("www."), F.lit(""))
    return F.coalesce(*[F.when(F.contains(host, F.lit(d)) | F.contains(F.lit(d), host), d) for d in domains], host)


def resolved(base: Column, href: Column) -> Column:
    """The absolute address of a link on the page base, with . and .. worked out."""
    scheme, root, folder = F.regexp_extract(base, "^([A-Za-z]+:)", 1), F.regexp_extract(base, "^([A-Za-z]+://[^/?#]*)", 1), F.regexp_extract(base, "^[A-Za-z]+://[^/?#]*(/?[^?#]*/|/?)", 1)
    page = F.regexp_replace(base, "#.*$", "")
    raw = F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(root, href))
    raw = raw.when(href.startswith("?"), F.concat(F.regexp_replace(page, r"\?.*$", ""), href)).when(href.startswith("#") | (href == ""), F.concat(page, href))
    raw = raw.otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), href))
    front, tail = F.regexp_extract(raw, "^([A-Za-z]+://[^/?#]*)", 1), F.regexp_extract(raw, r"^[^?#]*([?#].*)?$", 1)
    path = F.regexp_extract(raw, "^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    none = F.array().cast("array<string>")
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    walked = F.aggregate(F.filter(parts, lambda p: p != "."), none, lambda a, p: F.when(p != "..", F.concat(a, F.array(p))).when(F.size(a) > 1, F.slice(a, 1, F.size(a) - 1)).otherwise(a))
    joined = F.array_join(walked, "/")
    clean = F.concat(joined, F.when(last.isin(".", "..") & ~joined.endswith("/"), "/").otherwise(""))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.concat(front, clean, F.coalesce(tail, F.lit("")))).otherwise(raw)


def listing_links(df: DataFrame, idx: str, url: str, page: str, limit: int = 25, patterns: dict[str, str] | None = None) -> DataFrame:
    """idx, ord and link of the first article links of each listing page.

    A feed's links are those of its <link> elements, a page's those of its <a>
    elements (a feed without any: these too). A link is resolved against the
    page; it stays if its host holds the page's host, the pattern of the page's
    domain finds it (where there is one) and it is none of the skipped kinds,
    links with a fragment among them; each link is listed once.
    """
    text, base = F.coalesce(F.col(page), F.lit("")), F.col(url)
    feed = F.contains(F.left(text, F.lit(400)), F.lit("<rss")) | F.contains(F.left(text, F.lit(200)), F.lit("<?xml"))
    items = F.when(feed, F.regexp_extract_all(text, F.lit(r"<link>\s*([^<\s]+)\s*</link>"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    anchors = F.regexp_extract_all(text, F.lit("""(?i)<a\\s[^>]*?href\\s*=\\s*["']([^"']*)["']"""), F.lit(1))
    own = lambda u: F.replace(F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("www."), F.lit(""))
    rows = df.select(F.col(idx), base.alias("__base"), domain_key(base).alias("__key"), F.when(F.size(items) > 0, items).otherwise(F.transform(anchors, unescaped_href)).alias("__raw"))
    links = F.transform("__raw", lambda h: resolved(F.col("__base"), F.trim(h)))
    wanted = lambda h: F.coalesce(*[F.when(F.col("__key") == d, h.rlike(p)) for d, p in (LINK_PATTERNS if patterns is None else patterns).items()], F.lit(True))
    links = F.filter(links, lambda h: F.contains(own(h), own(F.col("__base"))) & wanted(h) & ~h.rlike(SKIP_LINK))
    links = F.array_distinct(F.transform(links, lambda h: F.regexp_replace(h, "#.*$", "")))
    return rows.select(F.col(idx), F.posexplode(F.slice(links, 1, limit)).alias("ord", "link"))


def unescaped_href(href: Column) -> Column:
    """The entities that addresses use."""
    for old, new in (("&#38;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        href = F.replace(href, F.lit(old), F.lit(new))
    return href


def hit_order(hits: DataFrame, order: list[str]) -> DataFrame:
    """Hits off blocked hosts, the first of each address."""
    from akshara.operators.articles import first_wins

    return first_wins(hits.where(~blocked(F.col("url"))).withColumn("url_key", X.url_key(F.col("url"))), "url_key", order)
