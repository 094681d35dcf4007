"""Sources, review operators and streaming forms on inline cases, and the queries against their SQL."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from akshara.operators import articles as A
from akshara.operators import review as R
from akshara.plans import review as plans
from akshara.sources import articles as SA
from akshara.sources import search as S
from akshara.streaming import articles as ST

SF = "/root/testdata/sf0.001"
TABLES = ("events", "documents", "pages", "labels", "conversations", "benchmark")


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = plans.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
    want = db.sql(plans.oracle_sql()[name])
    at = [want.columns.index(c) for c in cols]
    assert got == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())
    assert got


def test_article_files(spark, tmp_path):
    rows = [{"title": "a", "topics": ["x"], "fact_score": 3}, {"title": "b"}]
    texts = {"bare": json.dumps(rows), "meta": json.dumps({"_meta": {"run": 1}, "articles": rows}), "empty": "", "broken": "[{", "object": "{}"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    got = {name: sorted(r.title for r in SA.read_articles(spark, str(tmp_path / name)).where("title is not null").collect()) for name in [*texts, "missing"]}
    assert got == {"bare": ["a", "b"], "meta": ["a", "b"], "empty": [], "broken": [], "object": [], "missing": []}


def test_registry(spark, tmp_path):
    (tmp_path / "r").write_text(json.dumps({"source_groups": {"g": {"sources": [{"name": "one", "priority": 2}, {"name": "two", "start_urls": ["u"]}]}}}))
    got = SA.read_registry(spark, str(tmp_path / "r")).orderBy("ord").collect()
    assert [(r.group, r.ord, r.name, r.priority, r.start_urls) for r in got] == [("g", 0, "one", 2, None), ("g", 1, "two", None, ["u"])]


def test_stage_runs(spark, tmp_path):
    for run in ("20260101", "20260102", "20260103"):
        SA.save_stage(spark.range(2), str(tmp_path), "web", "crawl", run)
    got = {r.run: (r.rows, r.newest, r.expired) for r in SA.stage_runs(spark, str(tmp_path), 2).collect()}
    assert got == {"20260101": (2, False, True), "20260102": (2, False, False), "20260103": (2, True, False)}


def test_rss(spark):
    item = "<item><title><![CDATA[A &amp; B]]></title><link>http://s.com/click.aspx?ref=1&amp;url=https%3a%2f%2fwww.p.com%2fx%3fid%3d1&amp;c=2</link><pubDate>Tue, 01 Sep 2026 10:00:00 GMT</pubDate><description>d</description></item>"
    feed = f"<rss><channel>{item}<item><link>ftp://no</link></item></channel></rss>"
    df = spark.createDataFrame([(feed, "q", "l"), (None, "q", "l")], "xml string, q string, l string")
    got = S.rss_hits(df, "xml", "q", "l", "rss").collect()
    assert [tuple(r) for r in got] == [(0, "https://www.p.com/x?id=1", "A & B", "p.com", "2026-09-01", "d", "rss", "q", "l")]


def test_json_results(spark):
    results = json.dumps([{"url": "https://a.com/1", "title": "T &amp; U ", "description": "<b>x</b> y", "page_age": "2026-09-01T00:00", "meta_url": {"hostname": "www.a.com"}}, {"title": "no url"}])
    df = spark.createDataFrame([(results, "q", "l"), ("junk", "q", "l")], "j string, q string, l string")
    got = S.json_hits(df, "j", "q", "l", "news").collect()
    assert [tuple(r) for r in got] == [(0, "https://a.com/1", "T & U", "a.com", "2026-09-01", "x y", "news", "q", "l")]


@pytest.mark.parametrize(("url", "expected"), [("https://www.msn.com/a", True), ("http://m.youtube.com/", True), ("https://www.amarujala.com/x.com", False), (None, False)])
def test_blocked(spark, url, expected):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(S.blocked(F.col("u")).alias("b")).first().b is expected


def test_freshness(spark):
    df = spark.createDataFrame([(d,) for d in (None, 0, 1, 3, 7, 10, 31, 90)], "d int")
    assert [r.p for r in df.select(S.freshness(F.col("d")).alias("p")).collect()] == [None, None, "pd", "pw", "pw", "pm", "pm", "py"]


def test_merge_and_split(spark):
    rows = spark.createDataFrame([(1, 0, "s", "", "first [a — b]\nline"), (1, 1, "t", "2026-01-01", "short")], "c int, i int, s string, d string, b string")
    out = A.merged_bodies(rows, "c", "i", "s", "d", "b").select(R.merged_parts(F.col("body")).alias("p")).first().p
    assert [tuple(x) for x in out] == [("s", "no date", "first [a — b]\nline"), ("t", "2026-01-01", "short")]
    plain = spark.createDataFrame([("[x] y",), (None,)], "b string").select(R.merged_parts(F.col("b")).alias("p")).collect()
    assert [[tuple(x) for x in r.p] for r in plain] == [[(None, None, "[x] y")], [(None, None, "")]]


def test_story_tabs(spark):
    schema = "id int, source_lang string, ai_headline string, ai_news_story string, ai_headline_translated string, ai_news_story_translated string"
    rows = spark.createDataFrame([(1, "en", "Head", "Story", "शीर्षक", "कहानी"), (2, "en", "Head", "Story", "More", "English"), (3, None, None, None, "", "")], schema)
    got = sorted(tuple(r) for r in R.story_tabs(rows, "id").collect())
    assert got == [(1, 1, "translation", "hi", "Hindi", "कहानी"), (1, 2, "original", "en", "English", "Story"), (2, 1, "original", "en", "English", "Story"), (2, 2, "translation", "en", "English (translation)", "English")]


def test_badges(spark):
    schema = "fact_score int, plagiarism_score int, plagiarism_detail string, coverage_score int, number_precision int, grounding_ceiling int, gates_passed boolean"
    rows = spark.createDataFrame([(85, 0, R.NOT_COMPARABLE[0], None, None, 100, True), (40, 36, "", 60, 80, 20, True), (None, 0, "", None, None, None, None)], schema)
    got = [([b.band for b in r.badges], r.needs_look) for r in R.badges(rows).collect()]
    assert got == [(["ok", "none", "none", "none", "ok"], False), (["err", "err", "ok", "warn", "warn"], True), (["none", "ok", "none", "none", "none"], False)]


def drained(spark, stream, name, mode="append"):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").limit(200).withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    once = drained(spark, ST.seen_once(stream, "event_type", "ts", "400 days"), "once")
    assert sorted(r.event_type for r in once) == sorted(r.event_type for r in events.select("event_type").distinct().collect())
    counts = drained(spark, ST.window_counts(stream, "ts", "event_type", "1 day"), "counts", "complete")
    assert sum(r.n for r in counts) == 200


def test_log_stream(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("=== S ===\n  OK x\n  OK y\n  skip (old) z\nFAILED\n")
    got = drained(spark, ST.progress(ST.log_lines(spark, str(tmp_path / "logs"))), "lines", "complete")
    assert {(r.log_name, r.kind): r.n for r in got} == {("a.log", "source"): 1, ("a.log", "kept"): 2, ("a.log", "skipped"): 1, ("a.log", "warning"): 1}
