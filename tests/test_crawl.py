"""Crawl chains, clusters, scoring and review against their SQL; files, windows and checks on small cases."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from akshara.operators import crawl as C
from akshara.operators import stories as T
from akshara.plans import crawl as plans
from akshara.sources import articles as AS
from akshara.sources import pages as P

SF = "/root/testdata/sf0.001"
TABLES = ("events", "documents", "pages", "labels", "conversations")


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


def test_windows():
    today = datetime.date(2026, 3, 1)
    assert C.last_days(1, today) == ("2026-03-01", "2026-03-01") and C.last_days(7, today) == ("2026-02-23", "2026-03-01")
    assert C.run_window(today, 0) == (None, None) and C.run_window(today, 0, "x") == ("x", None) and C.run_window(today)[0] == "2026-02-23"


def test_unknown_engines_and_zones(spark):
    assert C.check_engines(["bing"]) == ["bing"]
    with pytest.raises(ValueError):
        C.check_engines(["bing", "other"])
    reports = spark.createDataFrame([("CR", "down"), ("WR", None)], "zone_code string, error string")
    assert C.check_zones(reports) == ["CR"]
    with pytest.raises(RuntimeError):
        C.check_zones(reports.where("error is not null"))


def test_articles_are_read_as_written(spark, tmp_path):
    rows = spark.createDataFrame([("A", ["x"], 5), ("B", None, None)], "title string, topics array<string>, fact_score int")
    path = str(tmp_path / "out")
    AS.write_articles(rows, path, {"run_id": "r1"})
    got = AS.read_lines(spark, path)
    assert sorted((r.title, r.topics, r.fact_score) for r in got.select("title", "topics", "fact_score").collect()) == [("A", ["x"], 5), ("B", None, None)]
    assert AS.read_meta(spark, path) == {"run_id": "r1"}
    AS.write_articles(rows.limit(1), path)
    assert AS.read_lines(spark, path).count() == 1 and AS.read_meta(spark, path) == {}
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_upper_median(spark):
    rows = spark.createDataFrame([("a", v) for v in (5, 1, 3, 3)] + [("b", 7)], "g string, v int")
    assert {r.g: r.upper_median for r in T.upper_median(rows, ["g"], F.col("v")).collect()} == {"a": 3, "b": 7}


def test_modes_put_every_article_in_one_cluster(spark):
    rows = spark.createDataFrame([(0, "Flood closes northern bridge", "b" * 10, "s"), (1, "Flood closes northern road bridge", "b" * 30, "t"), (2, "", "", None)], "idx int, title string, body string, source string")
    for mode in T.MODES:
        members = T.cluster_members(rows, mode)
        assert sorted(r.idx for r in members.collect()) == [0, 1, 2]
    found = T.cluster_rollup(T.cluster_members(rows, "story"), rows).collect()
    assert [(r["size"], r.lead, r.sources) for r in found] == [(2, 1, ["s", "t"]), (1, 2, [""])]
    with pytest.raises(ValueError):
        T.cluster_members(rows, "other")


def test_hostile_pages():
    for page in ("<", "<p", "</div></p>", "<p>" * 3000, "<!-- x", "<a href='x"):
        assert P.extracted("x.com", page)[0] == ""


def test_queries_without_the_training_data_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parents[1]
    shutil.copytree(root / "akshara", tmp_path / "akshara", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); assert q and not any(k.startswith('op1_') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_reports_over_scores_read_the_texts_once(spark):
    from akshara.plans import crawl

    assert crawl.topic_report(spark, "/root/testdata/sf0.001").inputFiles() == []
