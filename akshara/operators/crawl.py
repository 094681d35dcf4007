"""What a crawl keeps: keyword filters, date windows, and the filter chains of searches and releases, as joins and windows over hits and pages."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from akshara.functions import lexicon as L
from akshara.functions import text as X
from akshara.operators import articles as A
from akshara.sources import search as S

# They must be these for equal results.
UNTRANSLATED, PDF_ONLY = "Add Hindi content here", "[PDF attached:"
ENGINES = ("brave", "bing")
DAYS_BACK = 7


def parse_keywords(raw: Column) -> Column:
    """The terms between commas and line breaks, trimmed; empty for no text."""
    terms = F.transform(F.split(F.coalesce(raw, F.lit("")), "[,\n]"), lambda t: F.regexp_replace(t, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.filter(terms, lambda t: t != "")


def keyword_list(raw: str | None) -> list[str]:
    """parse_keywords() of a run's own parameter."""
    return [t.strip() for t in (raw or "").replace("\n", ",").split(",") if t.strip()]


def matches_keywords(keywords: list[str]) -> Column:
    """Whether any keyword occurs: phrases in the blob, words as tokens or by equal stems. No keywords: always; needs the columns of with_tokens()."""
    if not keywords:
        return F.lit(True)
    terms = [X.normal_term(k) for k in keywords]
    return (F.col("blob") != "") & (F.size(X.term_hits(terms, F.col("blob"), F.col("words"), F.col("stems"))) > 0)


def passes_topic(keywords: list[str], mode: str = "narrow", strong=L.STRONG, weak=L.WEAK) -> Column:
    """The topic gate: the subject alone without keywords, keywords alone in mode only, else both."""
    if not keywords:
        return A.relevant(strong=strong, weak=weak)
    return matches_keywords(keywords) if mode == "only" else A.relevant(strong=strong, weak=weak) & matches_keywords(keywords)


def last_days(days: int, today: datetime.date) -> tuple[str, str]:
    """First and last day of the window of so many days that ends today."""
    return str(today - datetime.timedelta(days=max(1, int(days)) - 1)), str(today)


def run_window(today: datetime.date, days: int | None = None, first: str | None = None, last: str | None = None, default: int = DAYS_BACK) -> tuple[str | None, str | None]:
    """An explicit range, else the last days (0: open), else the default."""
    if first or last:
        return first, last
    if days is not None and int(days) == 0:
        return None, None
    return last_days(default if days is None else days, today)


def dated(df: DataFrame, date: str, window: tuple[str | None, str | None], keep_undated: bool = True) -> DataFrame:
    """df with verdict (kept, too_old or undated) and kept: undated rows as keep_undated says; an open window knows no undated rows."""
    inside = X.in_window(X.parsed_date(F.col(date)), *window)
    verdict = F.when(inside, "kept").when(~inside, "too_old").otherwise("undated")
    return df.withColumn("verdict", verdict).withColumn("kept", (F.col("verdict") == "kept") | (F.col("verdict") == "undated") & F.lit(keep_undated))


def check_engines(engines: list[str], known=ENGINES) -> list[str]:
    unknown = [e for e in engines if e not in known]
    if unknown:
        raise ValueError(f"unknown engine(s) {unknown}. Available: {list(known)}")
    return engines


def truncated_title(title: Column) -> Column:
    return F.coalesce((title == "") | title.endswith("...") | title.endswith("…"), F.lit(True))


def search_plan(keywords: DataFrame, engines: DataFrame) -> DataFrame:
    """Every keyword (ord, keyword) with every engine (ord, engine), in order; both are lists of a run's parameters."""
    n = F.lit(engines.count())
    rows = keywords.withColumnRenamed("ord", "k").crossJoin(F.broadcast(engines.withColumnRenamed("ord", "e")))
    return rows.select((F.col("k") * n + F.col("e")).alias("ord"), "keyword", "engine")


def first_before(rows: DataFrame, marks: DataFrame, key: str, flag: str) -> DataFrame:
    """rows with flag: whether a mark (key, query, ord, active) of the row's key stands before it that is active or of its own query. Empty keys have none."""
    per = marks.where(F.col(key) != "").groupBy(key, "query").agg(F.min("ord").alias("__own"), F.min(F.when(F.col("active"), F.col("ord"))).alias("__act"))
    every = per.groupBy(key).agg(F.min("__act").alias("__act"))
    out = rows.join(per.select(key, "query", "__own"), [key, "query"], "left").join(every, key, "left")
    return out.withColumn(flag, F.coalesce(F.col("__own") < F.col("ord"), F.lit(False)) | F.coalesce(F.col("__act") < F.col("ord"), F.lit(False))).drop("__own", "__act")


def search_facts(hits: DataFrame, pages: DataFrame, window: tuple[str | None, str | None], keywords: list[str] | None, mode: str, keep_undated: bool, min_body: int, strong, weak) -> DataFrame:
    """What is known of each hit by itself: its keys and why it would go; of bodies only lengths and openings travel."""
    none = F.lit("")
    head = pages.select(F.col("url").alias("__url"), F.length(F.coalesce("body", none)).alias("__chars"), F.left(F.coalesce("body", none), F.lit(600)).alias("__head"), "real_url", "page_date", "extractor", "page_title")
    rows = hits.join(head, F.col("url") == F.col("__url"), "left")
    inside = lambda c: X.in_window(X.parsed_date(F.col(c)), *window)
    rows = rows.withColumn("final_title", F.when(truncated_title(F.col("title")), F.coalesce("page_title", none)).otherwise(F.col("title")))
    rows = rows.withColumn("final_date", F.coalesce(F.nullif("page_date", none), "date", none)).withColumn("__in", inside("final_date"))
    rows = A.with_tokens(rows, F.concat_ws(" ", "final_title", F.coalesce("__head", none))).withColumn("__topic", passes_topic(keywords or [], mode, strong, weak))
    undated = F.col("__in").isNull() & F.lit(not keep_undated)
    later = F.when(F.coalesce("__chars", F.lit(0)) < min_body, "body too short").when(~F.col("__topic"), "off-topic").when(undated, "no date on page").when(~F.col("__in"), "outside the date window")
    link = F.coalesce("real_url", "url")
    return rows.select(
        "ord", "query", "engine", "url", link.alias("link"), "final_title", "final_date", "source", "listing_url", "extractor", F.col("__in").isNull().alias("undated"),
        S.blocked(F.col("url")).alias("blocked"), F.coalesce(~inside("date"), F.lit(False)).alias("old"), later.alias("later"),
        X.url_key(F.col("url")).alias("key"), X.url_key(link).alias("real_key"), X.normal_key(F.col("title")).alias("hit_key"), X.normal_key(F.col("final_title")).alias("title_key"),
    )


def search_chain(hits: DataFrame, pages: DataFrame, window: tuple[str | None, str | None], keywords: list[str] | None = None, mode: str = "narrow", cap: int | None = None, keep_undated: bool = True, min_body: int = 300, strong=L.STRONG, weak=L.WEAK) -> DataFrame:
    """Every hit with its reason: kept, or why it is left out; kept rows have their body.

    hits: ord (unique, the order in which a run meets them; a query's hits stand
    together), query, engine, url, title, date, source, listing_url. pages (one
    a url): url, body, real_url, page_date, extractor, page_title. An address
    counts from its first hit that no blocked host has, and so does that a page
    was really found at; a title counts once kept. Once a query has kept cap
    hits, its later ones are not looked at and leave addresses and titles free.

    What a hit meets follows from hits before it alone. So all are judged at
    once against the verdicts of the round before, until a round changes
    nothing: every round settles at least the first hits that were not, and in
    practice all but a few chains of repeats and caps after two or three.
    """
    rows = A.checkpointed(search_facts(hits, pages, window, keywords, mode, keep_undated, min_body, strong, weak))
    # at first every hit is taken that nothing of its own speaks against
    now = rows.withColumns({"seen": F.lit(False), "known": F.lit(False), "again": F.lit(False), "active": F.lit(True), "fetched": ~F.col("blocked") & ~F.col("old")}).withColumn("kept", F.col("fetched") & F.col("later").isNull())
    state = None
    while True:
        marks = now.where(~F.col("blocked")).select("key", "query", "ord", "active")
        marks = marks.unionByName(now.where("fetched").select(F.col("real_key").alias("key"), "query", "ord", "active"))
        titles = now.where("kept").select("title_key", "query", "ord", "active")
        judged = first_before(rows, marks, "key", "seen")
        judged = first_before(judged, titles.withColumnRenamed("title_key", "hit_key"), "hit_key", "known")
        judged = first_before(judged, titles, "title_key", "again")
        judged = judged.withColumn("fetched", ~(F.col("blocked") | F.col("seen") | F.col("known") | F.col("old"))).withColumn("kept", F.col("fetched") & F.col("later").isNull() & ~F.col("again"))
        judged = A.checkpointed(judged)
        if cap is None:
            judged = judged.withColumn("active", F.lit(True))
        else:
            place = F.row_number().over(Window.partitionBy("query").orderBy("ord"))
            cuts = judged.where("kept").select("query", "ord").withColumn("__n", place).where(F.col("__n") <= cap).groupBy("query").agg(F.max("ord").alias("__cut"), F.max("__n").alias("__n")).where(F.col("__n") == cap)
            judged = judged.join(cuts.select("query", "__cut"), "query", "left").withColumn("active", F.coalesce(F.col("ord") <= F.col("__cut"), F.lit(True))).drop("__cut")
        now = judged
        seen = now.agg(F.sum(F.xxhash64("ord", "fetched", "kept", "active").cast("decimal(38,0)")).alias("s")).first().s
        if seen == state:
            break
        state = seen
    reason = F.when(~F.col("active"), "beyond the cap").when(F.col("blocked"), "aggregator or social site").when(F.col("seen"), "already have this URL").when(F.col("known"), "already have this story").when(F.col("old"), "outside the date window")
    out = now.withColumn("reason", reason.otherwise(F.coalesce("later", F.when(F.col("again"), "already have this story"), F.lit("kept"))))
    kept = out.where("reason = 'kept'").select("ord", "url").join(pages.select("url", "body"), "url").select("ord", "body")
    return out.join(kept, "ord", "left").select("ord", "query", "engine", "link", F.col("final_title").alias("title"), F.col("final_date").alias("date"), "source", "listing_url", "body", "extractor", "reason", "undated")


def kept_by_engine(chain: DataFrame) -> DataFrame:
    """Per engine: articles kept and their publishers."""
    return chain.groupBy("engine").agg(F.count_if(F.col("reason") == "kept").alias("kept"), F.countDistinct(F.when(F.col("reason") == "kept", F.col("source"))).alias("publishers"))


def thin_reason(body: Column, least: int = 200) -> Column:
    """Why a release's body is too thin, null for one that is not."""
    text = F.coalesce(body, F.lit(""))
    why = F.when(F.contains(text, F.lit(UNTRANSLATED)), "untranslated template").when(F.contains(text, F.lit(PDF_ONLY)), "PDF-only (no inline text)").otherwise(F.format_string("%d chars", F.length(text)))
    return F.when(F.length(text) < least, why)


def zone_dedup(df: DataFrame, order: list[str]) -> DataFrame:
    """df with repeat: whether an earlier row of its zone has the title's key; an empty key counts like any other."""
    key = F.concat(F.coalesce("zone_code", F.lit("")), F.lit("||"), X.normal_key(F.col("title")))
    return df.withColumn("__k", key).withColumn("repeat", F.row_number().over(Window.partitionBy("__k").orderBy(*order)) > 1).drop("__k")


def release_chain(releases: DataFrame, window: tuple[str | None, str | None], keywords: list[str] | None = None, hindi_only: bool = False, per_zone: int | None = None, least: int = 200) -> DataFrame:
    """Every release (ord, zone_code, zone_name, title, date, link, body) with its ratios and its reason: kept, or why not.

    A bound drops releases without a date too. per_zone takes the first of each
    zone that the window leaves; then thin bodies, repeats in a zone, keywords
    and English bodies go, in this order.
    """
    open_window = window == (None, None)
    inside = F.lit(True) if open_window else F.coalesce(X.in_window(X.parsed_date(F.col("date")), *window), F.lit(False))
    rows = releases.withColumn("__in", inside)
    place = F.row_number().over(Window.partitionBy("zone_code", "__in").orderBy("ord"))
    rows = rows.withColumn("__take", F.col("__in") & (place <= per_zone if per_zone is not None else F.lit(True))).withColumn("__thin", thin_reason(F.col("body"), least))
    taken = F.col("__take") & F.col("__thin").isNull()
    again = F.row_number().over(Window.partitionBy("zone_code", X.normal_key(F.col("title")), taken).orderBy("ord")) > 1
    rows = rows.withColumn("__again", again)
    rows = A.with_tokens(rows, F.concat_ws(" ", "title", F.left(F.coalesce("body", F.lit("")), F.lit(600)))).withColumn("__match", matches_keywords(keywords or [])).drop("blob", "words", "stems")
    ratio = lambda c: F.bround(X.script_ratio(F.coalesce(F.col(c), F.lit(""))), 2)
    hindi = X.script_ratio(F.coalesce(F.col("body"), F.lit(""))) >= 0.5
    rows = rows.withColumns({"title_hindi_ratio": ratio("title"), "body_hindi_ratio": ratio("body"), "is_hindi_body": hindi, "source": F.concat("zone_name", F.lit(" (RSB Hindi)"))})
    reason = F.when(~F.col("__in"), "outside the date window").when(~F.col("__take"), "beyond the cap").when(F.col("__thin").isNotNull(), F.col("__thin")).when(F.col("__again"), "duplicate").when(~F.col("__match"), "no keyword match")
    reason = reason.when(F.lit(hindi_only) & ~F.col("is_hindi_body"), "not Hindi").otherwise("kept")
    return rows.withColumn("reason", reason).drop("__in", "__take", "__thin", "__again", "__match")


def newest_release(releases: DataFrame) -> DataFrame:
    """zone_code and newest, the day of each zone's newest dated release, whatever the window; the zone of the newest of all is marked."""
    day = releases.groupBy("zone_code").agg(F.max(X.parsed_date(F.col("date"))).alias("newest")).where("newest is not null")
    top = day.agg(F.max(F.struct("newest")).alias("m"))
    return day.crossJoin(F.broadcast(top)).select("zone_code", F.col("newest").cast("string").alias("newest"), (F.col("newest") == F.col("m.newest")).alias("overall"))


def check_zones(reports: DataFrame) -> list[str]:
    """The zones (a registry's few rows: zone_code, error) that could not be read; raises where none could."""
    rows = reports.orderBy("zone_code").collect()
    failed = [r.zone_code for r in rows if r.error]
    if rows and len(failed) == len(rows):
        raise RuntimeError(f"Could not reach any railway zone website ({rows[0].zone_code}: {rows[0].error[:200]})")
    return failed


def zone_address(url: Column, lang: int = 1) -> Column:
    """A zone's listing address in its Hindi edition."""
    return F.regexp_replace(url, "lang=[0-9]", f"lang={lang}")


def with_coverage(zones: DataFrame, coverage: DataFrame) -> DataFrame:
    """Zones with the note on their Hindi coverage, null where none was made; coverage is a registry of a few rows."""
    return zones.join(F.broadcast(coverage), "zone_code", "left")


def listing_for(articles: DataFrame, registry: DataFrame) -> DataFrame:
    """articles with listing and listing_exact: the recorded address, else the registry's (name, start_urls) for the zone or source.

    The registry is a configuration file's rows.
    """
    n = F.size("start_urls")
    guess = F.when(n == 1, F.get("start_urls", F.lit(0))).when(n > 1, F.concat(F.get("start_urls", F.lit(0)), F.lit(" (+"), (n - 1).cast("string"), F.lit(" more)")))
    known = registry.select(F.col("name"), guess.alias("guess")).where("guess is not null").dropDuplicates(["name"])
    rows = articles.join(F.broadcast(known.select(F.col("name").alias("__z"), F.col("guess").alias("__zone"))), F.col("zone_code") == F.col("__z"), "left")
    rows = rows.join(F.broadcast(known.select(F.col("name").alias("__s"), F.col("guess").alias("__source"))), F.col("source") == F.col("__s"), "left")
    exact = F.coalesce(F.col("listing_url") != "", F.lit(False))
    return rows.withColumn("listing", F.when(exact, F.col("listing_url")).otherwise(F.coalesce("__zone", "__source", F.lit("")))).withColumn("listing_exact", exact).drop("__z", "__zone", "__s", "__source")


def plain_error(text: Column) -> Column:
    """The last line of a traceback without the exception's class."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    last = F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit(""))
    inner = F.regexp_extract(last, r"^[A-Za-z_.]*(?:Error|Exception|Interrupt|Exit)\w*:\s*(.+)$", 1)
    return F.when(inner != "", inner).otherwise(last)


def log_name_parts(name: Column) -> Column:
    """date, time, pipeline, step and stem of date-time-pipeline-step.log; the step is the last part and the pipeline all between."""
    stem = F.regexp_replace(name, r"\.log$", "")
    parts = F.split(stem, "-")
    full = F.size(parts) >= 4
    part = lambda c: F.when(full, c).otherwise("")
    middle = F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 3, F.lit(0))), "-")
    return F.struct(part(F.get(parts, F.lit(0))).alias("date"), part(F.get(parts, F.lit(1))).alias("time"), part(middle).alias("pipeline"), part(F.element_at(parts, -1)).alias("step"), stem.alias("stem"))


def parse_env(lines: DataFrame, line: str = "value") -> DataFrame:
    """key and value of KEY=VALUE lines: comments go, export too, and one layer of quotes."""
    text = F.regexp_replace(F.trim(F.col(line)), r"^export\s+", "")
    rows = lines.select(text.alias("t")).where((F.col("t") != "") & ~F.col("t").startswith("#") & F.contains("t", F.lit("=")))
    value = F.trim(F.regexp_replace("t", "^[^=]*=", ""))
    bare = F.when(value.rlike(r"""^(".*"|'.*')$""") & (F.length(value) >= 2), F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)
    return rows.select(F.trim(F.substring_index("t", "=", 1)).alias("key"), bare.alias("value")).where("key <> ''")


def search_address(base: str, keyword: Column) -> Column:
    """The address of a keyword's public search page."""
    return F.concat(F.lit(base), F.url_encode(keyword))
