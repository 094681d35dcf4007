"""Stored responses of search engines: pruned folders, windows in the scan, counts, errors."""

import json

import pytest

from akshara.sources import responses as R

ITEM = "<item><title>{0}</title><link>http://x.org/{0}</link>{1}</item>"
DAY = "<pubDate>Mon, 0{} Feb 2024 08:00:00 GMT</pubDate>"


def feed(*days):
    return "<rss>" + "".join(ITEM.format(i, DAY.format(d) if d else "") for i, d in enumerate(days)) + "</rss>"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("responses") / "store")
    found = json.dumps({"results": [{"title": "no address"}, {"url": "http://y.org/1", "title": "a &amp; b", "page_age": "2024-02-05T00:00:00"}, {"url": "http://y.org/2", "page_age": None}]})
    rows = [("bing", "rail", "1", 200, feed(1, 5, 3)), ("bing", "rail", "2", 200, feed(1, 2)), ("bing", "rail", "3", 200, feed(1, None)), ("bing", "metro", "1", 200, feed(9)), ("bing", "rail", "4", 200, "<html>"), ("bing", "rail", "5", 503, None), ("bing", "rail", "6", 200, "<rss></rss>"), ("brave", "rail", "1", 200, found), ("brave", "rail", "2", 429, "too\nmany"), ("brave", "rail", "3", 200, "{"), ("brave", "rail", "4", 200, "{}"), ("brave", "rail", "5", 200, None)]
    R.save_responses(spark.createDataFrame([(e, k, r, s, "l", b) for e, k, r, s, b in rows], "engine string, keyword string, response string, status int, listing_url string, body string"), path)
    return path


def of(hits):
    return sorted((r.engine, r.keyword, r.response, r.ord, r.url, r.date) for r in hits.collect())


def test_hits_of_a_window(spark, store):
    want = [("bing", "rail", "1", 1, "http://x.org/1", "2024-02-05"), ("bing", "rail", "1", 2, "http://x.org/2", "2024-02-03"), ("bing", "rail", "3", 1, "http://x.org/1", ""), ("brave", "rail", "1", 0, "http://y.org/1", "2024-02-05"), ("brave", "rail", "1", 1, "http://y.org/2", "")]
    assert of(R.engine_hits(spark, store, ["rail"], since="2024-02-03")) == want
    # a count takes a response's first hits, whatever their day
    assert of(R.engine_hits(spark, store, ["rail"], since="2024-02-03", count=2)) == [want[0], *want[2:]]
    assert of(R.engine_hits(spark, store, ["rail"], ["brave"])) == want[3:]
    assert len(of(R.engine_hits(spark, store))) == 10 and of(R.engine_hits(spark, store, ["none"])) == []
    with pytest.raises(ValueError, match="unknown engine"):
        R.engine_hits(spark, store, engines=["other"])


def test_errors(spark, store):
    got = {(r.engine, r.response): r.error for r in R.response_errors(spark, store, ["rail"]).collect()}
    assert got == {("bing", "4"): "response was not an RSS feed", ("bing", "5"): "HTTP 503", ("brave", "2"): "HTTP 429: too many", ("brave", "3"): "response was not JSON", ("brave", "5"): "response was not JSON"}


def test_folders_and_days_are_pruned_in_the_scan(spark, store):
    plan = R.stored(spark, store, ["rail"], ["bing"], "2024-02-03")._jdf.queryExecution().toString()
    scan = next(line for line in plan.splitlines() if "PartitionFilters" in line and "PushedFilters" in line)
    assert "engine" in scan.split("PartitionFilters")[1].split("]")[0] and "GreaterThanOrEqual(newest" in scan
    # responses without any result are not read either
    assert sorted(r.response for r in R.stored(spark, store, ["rail"], ["bing"], "2024-02-03").collect()) == ["1", "3"]
