"""Clusters as a table, scoring in one call, resume and upsert, selections, and the reports over scored articles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from akshara.functions import lexicon as L
from akshara.functions import text as X
from akshara.functions.topics import TOPICS
from akshara.operators import articles as A
from akshara.operators import review as R

MODES = ("off", "story", "topic")
WORD = f"[{X.DEVANAGARI}]"


def blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def upper_median(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    """by and upper_median, the value at place n // 2 of the sorted values (null ones left out): counts of equal values are summed up, no group is held."""
    counts = df.select(*by, value.alias("__v")).where("__v is not null").groupBy(*by, "__v").agg(F.count("*").alias("__c"))
    run = F.sum("__c").over(Window.partitionBy(*by).orderBy("__v"))
    total = F.sum("__c").over(Window.partitionBy(*by))
    rows = counts.withColumns({"__run": run, "__half": F.floor(total / 2)})
    return rows.where((F.col("__run") > F.col("__half")) & (F.col("__run") - F.col("__c") <= F.col("__half"))).select(*by, F.col("__v").alias("upper_median"))


def body_report(df: DataFrame, by: list[str], body: str, lang: str) -> DataFrame:
    """Per group: articles, shortest, upper_median, longest body, how many are under 300 characters, languages and mean length."""
    n = F.length(body)
    out = df.groupBy(*by).agg(F.count("*").alias("articles"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.count_if(n < 300).alias("short"), F.countDistinct(lang).alias("langs"), F.bround(F.avg(n.cast("double")), 1).alias("mean_chars"))
    return out.join(upper_median(df, by, n), by, "left")


def histogram(df: DataFrame, column: str, most: int | None = None) -> DataFrame:
    """Values of a column (null: "unknown") with their counts, the frequent first, equal ones by first appearance in the order of idx; most: so many."""
    out = df.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias(column)).agg(F.count("*").alias("n"), F.min("idx").alias("first"))
    out = out.orderBy(F.desc("n"), "first")
    return out.limit(most) if most else out


def cluster_members(df: DataFrame, mode: str = "story", idx: str = "idx", title: str = "title", body: str = "body", threshold: float = 0.20, topics=TOPICS) -> DataFrame:
    """idx, cluster, chars, place (from 0, the longest body first, equal ones by idx) and topics of every article; each is in one cluster.

    off: every article by itself; topic: by its strongest topic, else
    "Unclassified"; story: single linkage of stemmed titles.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {list(MODES)}, got {mode!r}")
    rows = A.with_tokens(df.select(F.col(idx).alias("idx"), F.col(title).alias("title"), F.col(body).alias("body")), F.concat_ws(" ", blank("title"), blank("body")))
    rows = rows.select("idx", "title", F.length(blank("body")).alias("chars"), R.derived_topics(3, topics).alias("topics"))
    if mode == "off":
        out = rows.withColumn("cluster", F.col("idx").cast("string"))
    elif mode == "topic":
        out = rows.withColumn("cluster", F.coalesce(F.get("topics", F.lit(0)), F.lit("Unclassified")))
    else:
        keys = rows.select("idx", X.story_key(blank("title")).alias("w"))
        found = A.story_components(keys, "idx", "w", threshold)
        out = rows.join(found, F.col("idx") == F.col("node")).withColumn("cluster", F.col("cluster").cast("string"))
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("chars"), "idx")) - 1
    return out.select("idx", "cluster", "chars", place.alias("place"), "topics", "title")


def cluster_rollup(members: DataFrame, sources: DataFrame, idx: str = "idx", source: str = "source") -> DataFrame:
    """One row per cluster: size, lead, title, sources in order, topics in the order first seen, chars; the largest first."""
    rows = members.join(sources.select(F.col(idx).alias("idx"), blank(source).alias("source")), "idx")
    out = rows.groupBy("cluster").agg(F.count("*").alias("size"), F.max(F.when(F.col("place") == 0, F.col("idx"))).alias("lead"), F.max(F.when(F.col("place") == 0, blank("title"))).alias("title"), F.array_sort(F.collect_set("source")).alias("sources"), F.sum("chars").alias("chars"), F.min("idx").alias("first"))
    seen = members.select("cluster", "place", F.posexplode("topics").alias("at", "topic")).groupBy("cluster", "topic").agg(F.min(F.struct("place", "at")).alias("s"))
    seen = seen.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "topic"))), lambda x: x["topic"]).alias("topics"))
    out = out.join(seen, "cluster", "left").withColumn("topics", F.coalesce("topics", F.array().cast("array<string>")))
    return out.orderBy(F.desc("size"), F.desc("chars"), "first").drop("first")


def cluster_inputs(df: DataFrame, members: DataFrame, rollup: DataFrame, most: int = 6000) -> DataFrame:
    """What a report generator reads: one row per cluster with the merged body, its parts' sources, links and titles, and derived_topics."""
    rows = df.join(members.select("idx", "cluster"), "idx")
    merged = A.merged_bodies(rows, "cluster", "idx", "source", "date", "body", most)
    return merged.join(rollup.select("cluster", F.col("topics").alias("derived_topics"), "title"), "cluster")


def summary_line(rollup: DataFrame) -> DataFrame:
    """One row: articles, reports, and clusters of more than one source."""
    return rollup.agg(F.sum("size").alias("articles"), F.count("*").alias("reports"), F.count_if(F.col("size") > 1).alias("multi"))


def resume_key(title: Column) -> Column:
    """Lower case, trimmed, white space collapsed: what a resumed run recognises a title by."""
    return F.regexp_replace(stripped(F.lower(F.coalesce(title, F.lit("")))), X.WHITE, " ")


def real_story(story: Column) -> Column:
    """Whether a story is text and not a placeholder of a failed run."""
    return F.coalesce((stripped(story) != "") & ~story.startswith("[") & ~story.startswith("Generation failed"), F.lit(False))


def cut_off(df: DataFrame) -> Column:
    """Whether an answer stopped early: its flag, or where it has none, whether the last fields (topics and fact_details) are empty."""
    empty = (F.coalesce(F.size("topics"), F.lit(0)) <= 0) & (blank("fact_details") == "")
    return F.coalesce(F.col("truncated"), empty) if "truncated" in df.columns else empty


def finished(df: DataFrame) -> Column:
    return real_story(F.col("ai_news_story")) & ~cut_off(df)


def run_estimate(rollups: dict[str, DataFrame], done: DataFrame, scored: DataFrame) -> DataFrame:
    """Per mode: counts (reports), calls (titles without a finished story), skipped, and checked (finished and scored); done and scored have a title."""
    keys = lambda df, name: df.select(resume_key(F.col("title")).alias("k")).distinct().withColumn(name, F.lit(True))
    every = reduce(DataFrame.unionByName, [r.select(F.lit(m).alias("mode"), resume_key(F.col("title")).alias("k")) for m, r in rollups.items()])
    rows = every.join(keys(done, "done"), "k", "left").join(keys(scored, "scored"), "k", "left")
    return rows.groupBy("mode").agg(F.count("*").alias("counts"), F.count_if(F.col("done").isNull()).alias("calls"), F.count_if("done").alias("skipped"), F.count_if(F.col("done") & F.col("scored")).alias("checked"))


def upserted(old: DataFrame, new: DataFrame, key: str = "title") -> DataFrame:
    """old with the rows of new: a row of new replaces those of its resume key; columns of old."""
    mark = lambda df: df.withColumn("__k", resume_key(F.col(key)))
    return mark(old).join(mark(new).select("__k").distinct(), "__k", "left_anti").unionByName(mark(new)).drop("__k").select(old.columns)


def to_write(inputs: DataFrame, written: DataFrame) -> DataFrame:
    """The inputs whose title no finished story has."""
    done = written.where(finished(written)).select(resume_key(F.col("title")).alias("__k")).distinct()
    return inputs.withColumn("__k", resume_key(F.col("title"))).join(done, "__k", "left_anti").drop("__k")


def score_articles(df: DataFrame, title: str = "title", body: str = "body", story: str = "ai_news_story", topics: str = "topics", level: str = "impact_level", strong=L.STRONG, weak=L.WEAK, vocabulary=TOPICS) -> DataFrame:
    """df with all checks of each article: figures carried, gates, topics with evidence and impact by the source's words."""
    out = A.coverage(df, body, story)
    out = A.with_tokens(out, F.concat_ws(" ", blank(title), F.left(blank(body), F.lit(600)))).withColumn("__off", ~A.relevant(strong=strong, weak=weak)).drop("blob", "words", "stems")
    out = A.gates(out, title, body, story, F.col("__off")).drop("__off")
    out = R.verified_topics(A.with_tokens(out, F.col(body)), topics, vocabulary)
    return A.impact(out, F.col(level)).drop("blob", "words", "stems")


def topic_report(scored: DataFrame) -> DataFrame:
    """One row: topics assigned, off_vocabulary, unsupported."""
    n = lambda c: F.sum(F.coalesce(F.size(c), F.lit(0)).cast("long"))
    return scored.agg(n(F.col("topics")).alias("assigned"), n(F.col("topics_off_vocabulary")).alias("off_vocabulary"), n(F.col("topics_unsupported")).alias("unsupported"))


def unsupported_topics(scored: DataFrame, idx: str, most: int = 6) -> DataFrame:
    """The topics that most often lack evidence, with their counts; equal ones by first appearance."""
    rows = scored.select(F.col(idx).alias("i"), F.posexplode("topics_unsupported").alias("at", "topic"))
    return rows.groupBy("topic").agg(F.count("*").alias("n"), F.min(F.struct("i", "at")).alias("first")).orderBy(F.desc("n"), "first").limit(most).select("topic", "n")


def impact_agreement(scored: DataFrame) -> DataFrame:
    """One row: articles, agreeing ones and the rounded percentage."""
    out = scored.agg(F.count("*").alias("n"), F.count_if("impact_agrees").alias("agree"))
    return out.withColumn("percent", X.percent(F.col("agree"), F.col("n")))


def has(pattern: str, text: Column) -> Column:
    return F.coalesce(text.rlike(pattern), F.lit(False))


def bilingual_scores(df: DataFrame) -> DataFrame:
    """df with bilingual_score (language known, story, translation, right direction: 25 each) and hindi_information_score (Hindi in source 35, story 35, translation 30)."""
    story, other = blank("ai_news_story"), blank("ai_news_story_translated")
    source = has(WORD, F.concat_ws(" ", blank("title"), blank("body")))
    points = lambda cond, n: F.when(cond, n).otherwise(0)
    right = ((F.col("source_lang") == "hi") & has(WORD, story) & has("[A-Za-z]", other)) | ((F.col("source_lang") == "en") & has("[A-Za-z]", story) & has(WORD, other))
    score = points(F.col("source_lang").isin("hi", "en"), 25) + points(F.length(stripped(story)) > 30, 25) + points(F.length(stripped(other)) > 30, 25) + points(right, 25)
    return df.withColumns({"bilingual_score": score, "hindi_information_score": points(source, 35) + points(has(WORD, story), 35) + points(has(WORD, other), 30)})


def bilingual_summary(df: DataFrame) -> DataFrame:
    """One row of counts and averages over articles, their stories and translations."""
    story, other = blank("ai_news_story"), blank("ai_news_story_translated")
    hindi_story, hindi_other = has(WORD, story), has(WORD, other)
    related = F.coalesce(F.col("source_lang") == "hi", F.lit(False)) | hindi_story | hindi_other
    both = (stripped(story) != "") & (stripped(other) != "")
    written = (story != "") & ~story.startswith("[") & ~story.startswith("Generation failed")
    out = df.agg(
        F.count("*").alias("total_articles"),
        F.count_if(written).alias("generated_articles"),
        F.count_if(both).alias("bilingual_complete_articles"),
        F.count_if(has(WORD, F.concat_ws(" ", blank("title"), blank("body")))).alias("source_has_hindi_articles"),
        F.count_if(hindi_story).alias("hindi_in_ai_story_articles"),
        F.count_if(hindi_other).alias("hindi_in_translation_articles"),
        *[F.bround(F.avg(F.when(cond, F.col(c).cast("double"))), 2).alias(f"avg_{c}_{name}") for c in ("fact_score", "plagiarism_score") for name, cond in (("all", F.lit(True)), ("hindi_related", related))],
    )
    return out.withColumn("bilingual_complete_pct", F.when(F.col("total_articles") > 0, F.bround(F.col("bilingual_complete_articles") / F.col("total_articles") * 100, 2)).otherwise(0.0))


def hindi_related(df: DataFrame, most: int | None = 25) -> DataFrame:
    """Rows of articles with Hindi anywhere or from a Hindi source, by idx, the first ones."""
    text = F.concat_ws(" ", *[blank(c) for c in ("title", "body", "ai_news_story", "ai_news_story_translated")])
    rows = df.where(has(WORD, text) | F.coalesce(F.col("source_lang") == "hi", F.lit(False))).orderBy("idx")
    rows = rows.limit(most) if most else rows
    return rows.select("idx", blank("source").alias("source"), blank("source_lang").alias("source_lang"), "fact_score", "plagiarism_score", has(WORD, blank("ai_news_story")).alias("story_has_hindi"), has(WORD, blank("ai_news_story_translated")).alias("translation_has_hindi"), F.left(blank("title"), F.lit(120)).alias("title"))


def changed_selection(excluded: DataFrame, articles: DataFrame, action: str, keys: DataFrame | None = None) -> DataFrame:
    """The excluded keys after an action (exclude, include, select_all, clear_excluded); keys that no article has go."""
    if action not in ("exclude", "include", "select_all", "clear_excluded"):
        raise ValueError(f"unknown selection action {action!r}")
    now = excluded.select("key")
    if action == "exclude":
        now = now.unionByName(keys.select("key"))
    elif action == "include":
        now = now.join(keys.select("key"), "key", "left_anti")
    else:
        now = now.limit(0)
    return now.distinct().join(articles.select("key"), "key", "left_semi")


def selection_view(articles: DataFrame, excluded: DataFrame, view: str = "all", q: str = "") -> DataFrame:
    """Articles of a view (all, selected, excluded) whose title, source or snippet holds q, with is_excluded."""
    rows = articles.join(excluded.select("key").distinct().withColumn("__x", F.lit(True)), "key", "left").withColumn("is_excluded", F.coalesce("__x", F.lit(False))).drop("__x")
    if view != "all":
        rows = rows.where(F.col("is_excluded") == (view == "excluded"))
    found = [F.contains(F.lower(c), F.lit(q.strip().lower())) for c in (blank("title"), blank("source"), X.snippet(F.col("body")))]
    return rows.where(found[0] | found[1] | found[2]) if q.strip() else rows


def social_panels(df: DataFrame, idx: str, show: str = "hi") -> DataFrame:
    """One row per post and language: idx, network, place, lang, text, chars, shown; a translation into the language of the original goes."""
    src = F.when(F.col("source_lang").isin("hi", "en"), F.col("source_lang")).otherwise("")
    other = F.when(src == "hi", "en").when(src == "en", "hi").otherwise("")
    panels = []
    for network in ("twitter", "facebook", "general"):
        pair = [F.struct(F.lit(k).alias("k"), blank(f"social_{network}{end}").alias("text"), R.text_language(F.col(f"social_{network}{end}"), guess).alias("lang")) for k, (end, guess) in enumerate((("", src), ("_translated", other)))]
        panels.append(F.struct(F.lit(network).alias("network"), F.array(*pair).alias("p")))
    rows = df.select(F.col(idx), F.explode(F.array(*panels)).alias("x")).select(idx, "x.network", F.filter("x.p", lambda p: p["text"] != "").alias("p"))
    same = F.get(F.transform("p", lambda p: p["lang"]), F.lit(0))
    rows = rows.withColumn("p", F.filter("p", lambda p, i: (i == 0) | (p["lang"] != same))).where(F.size("p") > 0)
    rows = rows.withColumn("p", F.array_sort(F.transform("p", lambda p: F.struct((p["lang"] != "hi").alias("late"), p["k"].alias("k"), p["lang"].alias("lang"), p["text"].alias("text")))))
    first = F.coalesce(F.get(F.filter(F.transform("p", lambda p, i: F.when(p["lang"] == show, i)), lambda i: i.isNotNull()), F.lit(0)), F.lit(0))
    rows = rows.select(idx, "network", first.alias("first"), F.posexplode("p").alias("place", "p"))
    return rows.select(idx, "network", "place", "p.lang", "p.text", F.length("p.text").alias("chars"), (F.col("place") == F.col("first")).alias("shown"))


#: Long texts of an article that have a block of their own on its page; body alone is source text.
TEXT_FIELDS = ("body", "ai_news_story", "ai_news_story_translated", "social_twitter", "social_facebook", "social_general", "social_twitter_translated", "social_facebook_translated", "social_general_translated", "impact_reason", "fact_details", "plagiarism_detail")


def detail_rows(df: DataFrame, idx: str) -> DataFrame:
    """One row per filled field of an article: idx, kind (source, text or value), field and value as text."""
    items = []
    for c in df.columns:
        if c != idx:
            kind = "source" if c == "body" else "text" if c in TEXT_FIELDS else "value"
            value = F.col(c).cast("string") if not df.schema[c].dataType.typeName() == "array" else F.array_join(F.col(c).cast("array<string>"), ", ")
            items.append(F.struct(F.lit(kind).alias("kind"), F.lit(c).alias("field"), value.alias("value")))
    return df.select(F.col(idx), F.inline(F.filter(F.array(*items), lambda x: F.coalesce(x["value"], F.lit("")) != "")))
