"""What a reviewer sees of an article: topics with evidence, language tabs, score badges, and the parts of a merged body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from akshara.functions import text as X
from akshara.functions.topics import TOPICS

#: Details that tell a copied-text score of 0 for texts too short to compare.
NOT_COMPARABLE = ("Insufficient text for comparison.", "AI text too short for n-gram analysis.")


def topic_evidence(topics=TOPICS) -> Column:
    """topic and hits of every topic of the vocabulary that the text names; needs the columns of with_tokens()."""
    found = [F.struct(F.lit(t).alias("topic"), X.term_hits(terms, F.col("blob"), F.col("words"), F.col("stems")).alias("hits")) for t, terms in topics.items()]
    return F.filter(F.array(*found), lambda x: F.size(x["hits"]) > 0)


def derived_topics(limit: int = 3, topics=TOPICS) -> Column:
    """The topics with most hits, equal ones by name."""
    ranked = F.array_sort(F.transform(topic_evidence(topics), lambda x: F.struct((-F.size(x["hits"])).alias("n"), x["topic"].alias("topic"))))
    return F.slice(F.transform(ranked, lambda x: x["topic"]), 1, limit)


def verified_topics(df: DataFrame, claimed: str, topics=TOPICS) -> DataFrame:
    """df of with_tokens() with the claimed topics split into verified, unsupported and off the vocabulary, and up to four hits of each verified one. Null claims count as none."""
    out = df.withColumns({"__c": F.coalesce(F.col(claimed), F.array().cast("array<string>")), "__e": topic_evidence(topics)})
    known, named = F.lit(list(topics)), F.transform("__e", lambda x: x["topic"])
    backed = F.filter("__e", lambda x: F.array_contains(F.col("__c"), x["topic"]))
    return out.withColumns(
        {
            "topics_verified": F.filter("__c", lambda t: F.array_contains(named, t)),
            "topics_unsupported": F.filter("__c", lambda t: F.array_contains(known, t) & ~F.array_contains(named, t)),
            "topics_off_vocabulary": F.filter("__c", lambda t: ~F.array_contains(known, t)),
            "topic_evidence": F.map_from_entries(F.transform(backed, lambda x: F.struct(x["topic"], F.slice(x["hits"], 1, 4)))),
        }
    ).drop("__c", "__e")


def text_language(text: Column, fallback: Column) -> Column:
    """hi for at least as many Devanagari characters as Latin letters, en for fewer, the fallback without either."""
    text = F.coalesce(text, F.lit(""))
    hi, en = X.script_letters(text)
    return F.when(hi + en == 0, fallback).when(hi >= en, "hi").otherwise("en")


def story_tabs(df: DataFrame, idx: str) -> DataFrame:
    """One row per story of an article that has text: idx, place (from 1, Hindi first), role, lang, label and body.

    df has source_lang, ai_headline, ai_news_story and their _translated forms.
    """
    own = F.when(F.col("source_lang").isin("hi", "en"), F.col("source_lang")).otherwise("")
    other = F.when(F.col("source_lang") == "hi", "en").when(F.col("source_lang") == "en", "hi").otherwise("")
    tab = lambda n, role, end, guess: F.struct(F.lit(n).alias("n"), F.lit(role).alias("role"), F.coalesce(F.col(f"ai_headline{end}"), F.lit("")).alias("headline"), F.coalesce(F.col(f"ai_news_story{end}"), F.lit("")).alias("body"), guess.alias("guess"))
    tabs = F.filter(F.array(tab(0, "original", "", own), tab(1, "translation", "_translated", other)), lambda t: (t["headline"] != "") | (t["body"] != ""))
    tabs = F.transform(tabs, lambda t: t.withField("lang", text_language(F.concat(t["headline"], F.lit(" "), t["body"]), t["guess"])))
    rows = df.select(F.col(idx), F.transform(tabs, lambda t: F.struct((t["lang"] != "hi").alias("late"), t["n"].alias("n"), t["role"].alias("role"), t["lang"].alias("lang"), t["body"].alias("body"))).alias("tabs"))
    same = F.size(F.array_distinct(F.transform("tabs", lambda t: t["lang"]))) < F.size("tabs")
    rows = rows.select(idx, same.alias("same"), F.posexplode(F.array_sort("tabs")).alias("place", "t"))
    name = F.when(F.col("t.lang") == "hi", "Hindi").when(F.col("t.lang") == "en", "English").otherwise("Story")
    label = F.concat(name, F.when(F.col("same") & (F.col("t.role") == "translation"), " (translation)").otherwise(""))
    return rows.select(idx, (F.col("place") + 1).alias("place"), "t.role", "t.lang", label.alias("label"), "t.body")


def copied_value(score: Column, detail: Column) -> Column:
    """The copied-text score, null where a 0 only says that the texts could not be compared."""
    return F.when((F.coalesce(score, F.lit(0)) == 0) & F.coalesce(detail.isin(*NOT_COMPARABLE), F.lit(False)), F.lit(None)).otherwise(score)


def badges(df: DataFrame) -> DataFrame:
    """df with badges (name, value, band of each score) and needs_look."""
    copied = copied_value(F.col("plagiarism_score"), F.col("plagiarism_detail"))
    rule = {"fact_score": (F.col("fact_score"), 80, 50, False), "plagiarism_score": (copied, 20, 35, True), "coverage_score": (F.col("coverage_score"), 60, 30, False), "number_precision": (F.col("number_precision"), 90, 75, False), "grounding_ceiling": (F.col("grounding_ceiling"), 70, 20, False)}
    all_of = [F.struct(F.lit(k).alias("name"), v.cast("int").alias("value"), X.band(v, *limits).alias("band")) for k, (v, *limits) in rule.items()]
    checked = F.col("gates_passed").isNotNull() | F.col("coverage_score").isNotNull()
    bad = ~F.coalesce("gates_passed", F.lit(True)) | (X.band(copied, 20, 35, True) == "err") | (X.band(F.col("coverage_score"), 60, 30) == "err")
    return df.withColumns({"badges": F.array(*all_of), "needs_look": checked & bad})


def merged_parts(body: Column) -> Column:
    """source, date and text of each part of a merged body; a part without a header keeps its text under nulls."""

    def part(chunk: Column) -> Column:
        first = F.trim(F.substring_index(chunk, "\n", 1))
        headed = chunk.contains("\n") & first.rlike(r"^\[.+? — .+?\]$")
        group = lambda i: F.when(headed, F.regexp_extract(first, r"^\[(.+?) — (.+?)\]$", i))
        rest = F.substr(chunk, F.instr(chunk, "\n") + F.lit(1))
        return F.struct(group(1).alias("source"), group(2).alias("date"), F.when(headed, rest).otherwise(chunk).alias("text"))

    return F.transform(F.split(F.coalesce(body, F.lit("")), "\n\n---\n\n"), part)
