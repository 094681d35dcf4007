"""Article functions and operators on inline cases with known results."""

import re
import time
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from akshara.functions import text as X
from akshara.operators import articles as A
from akshara.plans import queries as Q
from akshara.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = ("events", "documents", "pages", "labels", "conversations")


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("text", "expected"), [("रात ८ बजे", ["8"]), ("1,53,000", ["153000"]), ("153000", ["153000"]), ("28/29.08", ["28", "29", "8"]), ("1.53", ["1", "53"]), ("007 000", ["7", "0"]), ("", []), (None, [])])
def test_numbers(spark, text, expected):
    assert sorted(one(spark, X.numbers, text)) == sorted(expected)


def test_stems(spark):
    stem = lambda w: one(spark, X.light_stem, w)
    assert stem("रेलगाड़ियों") == stem("रेलगाड़ी")
    assert stem("ट्रेनों") == stem("ट्रेन")
    assert stem("ट्रेनिंग") != stem("ट्रेन")


def test_nukta_forms_have_one_key(spark):
    a, b = (one(spark, X.normal_key, t) for t in ("हावड़ा", "हावड़ा"))
    assert a == b != ""


@pytest.mark.parametrize("text", ["Café", "Cafe\u0301", "na\u00efve x\u0301y", "e\u0323\u0302", "E\u0301a", "plain", "q\u0301 z"])
def test_keys_of_joined_letters_equal_those_of_full_normalisation(spark, text):
    want = re.sub(r"[^a-z0-9\u0900-\u097f\s]", "", unicodedata.normalize("NFC", text).lower()).strip()
    assert one(spark, X.normal_key, text) == re.sub(r"\s+", " ", want)


@pytest.mark.parametrize(("url", "expected"), [("https://www.jagran.com/a/b.html?utm_source=bing#top", "jagran.com/a/b.html"), ("http://jagran.com/a/b.html/", "jagran.com/a/b.html"), ("http://x.com/?b=2&a=1&UTM_x=3", "x.com?a=1&b=2"), (None, "")])
def test_url_key(spark, url, expected):
    assert one(spark, X.url_key, url) == expected


@pytest.mark.parametrize("text", ["2026-09-06", "06-09-2026", "06/09/2026", "2026/09/06", "06.09.2026", "6 Sep 2026", "6 September 2026", "Sep 6, 2026", "September 6, 2026", "2026-09-06T18:27:00+05:30", " 2026-09-06 "])
def test_dates(spark, text):
    assert str(one(spark, X.parsed_date, text)) == "2026-09-06"


@pytest.mark.parametrize("text", ["31-02-2026", "soon", "", None, "2026-09-06 junk junk"[11:]])
def test_no_dates(spark, text):
    assert one(spark, X.parsed_date, text) is None


def test_relevance(spark):
    rows = spark.createDataFrame([(1, "रेलगाड़ियों का आंशिक रद्दीकरण"), (2, "प्रशिक्षण ट्रेनिंग कार्यक्रम आयोजित"), (3, "भारतीय क्रिकेट टीम के मुख्य कोच गौतम गंभीर")], "id int, t string")
    got = {r.id: r.ok for r in A.with_tokens(rows, F.col("t")).select("id", A.relevant().alias("ok")).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_percentages_round_half_to_even(spark):
    assert spark.range(1).select(X.percent(F.lit(1), F.lit(8)).alias("p")).first().p == 12


def test_single_linkage_chains(spark):
    nodes = spark.range(6).withColumnRenamed("id", "node")
    edges = spark.createDataFrame([(3, 4), (1, 3), (0, 1)], "a long, b long")
    assert {r.node: r.cluster for r in A.components(nodes, edges).collect()} == {0: 0, 1: 0, 3: 0, 4: 0, 2: 2, 5: 5}


def test_merge_cuts_at_a_late_blank_line(spark):
    body = "a" * 300 + "\n\n" + "b" * 400
    rows = spark.createDataFrame([(1, 0, "s", "", body), (1, 1, "", "2026-01-01", "short"), (2, 2, "t", "", body)], "c int, i int, s string, d string, b string")
    got = {r.c: r for r in A.merged_bodies(rows, "c", "i", "s", "d", "b", 600).collect()}
    assert got[1].body == "[s — no date]\n" + "a" * 300 + " […]\n\n---\n\n[unknown — 2026-01-01]\nshort"
    assert (got[1].cluster_size, got[1].cluster_trimmed, got[2].body) == (2, 1, body)


def test_empty_keys_are_never_duplicates(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, ""), (4, ""), (5, None)], "id int, k string")
    assert sorted(r.id for r in A.first_wins(rows, "k", ["id"]).collect()) == [1, 3, 4, 5]


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


def test_inflected_titles_cluster(spark, monkeypatch):
    from akshara.plans import queries

    rows = spark.createDataFrame([(1, "सड़कों स्टेशनों"), (2, "सड़क स्टेशन"), (3, "बंदरगाह")], "doc_id long, title string")
    monkeypatch.setattr(queries, "articles", lambda spark, sf_dir: rows)
    assert {r.doc_id: r.cluster for r in queries.clustered(spark, "").collect()} == {1: 1, 2: 1, 3: 3}


def test_gates_join_figures_and_beginnings_of_texts(spark, tmp_path):
    rows = [(1, "title 5\n" + "a 12 " * 400, "en", "s"), (2, "title\n" + "b 12 7 " * 400, "en", "s"), (3, None, "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    out = Q.gated(spark, str(tmp_path))
    found = {r.doc_id: r for r in out.collect()}
    assert len(found[1].body) == 600 and found[1].source_numbers == 2 and found[1].numbers_unsupported == ["7"]
    assert "degenerate story" in found[2].gate_failures and set(found) == {1, 2}


def test_keys_and_shares_of_long_texts_cost_a_few_passes(spark, tmp_path):
    """26 patterns at every place, ten replacements and a string for each letter took several times as long."""
    text = F.concat(F.repeat(F.lit("रेल मंत्रालय ने नई घोषणा की "), F.lit(20_000)), F.col("id").cast("string"))
    spark.range(0, 4, 1, 1).select(text.alias("t")).write.parquet(f"{tmp_path}/texts")
    rows = spark.read.parquet(f"{tmp_path}/texts").coalesce(1)

    def least(column):
        took = []
        for _ in range(4):
            began = time.time()
            rows.select(column.alias("x")).agg(F.max(F.hash("x"))).first()
            took.append(time.time() - began)
        return min(took)

    one_pass = least(F.regexp_replace("t", f"[^a-z0-9{X.DEVANAGARI}\\s\\p{{Z}}]", ""))
    assert least(X.normal_key(F.col("t"))) < 4.5 * one_pass
    assert least(X.script_ratio(F.col("t"))) < 2.6 * one_pass


@pytest.mark.parametrize(("text", "hi", "en"), [(None, None, None), ("", 0, 0), ("aZ é9 \u0900\u097f\u0980\U0001f600", 2, 2), ("नई-line", 2, 4)])
def test_letters_of_scripts(spark, text, hi, en):
    a, b = X.script_letters(F.col("x"))
    assert tuple(spark.createDataFrame([(text,)], "x string").select(a, b).first()) == (hi, en)


def test_documents_of_one_row_group_are_dealt_out(spark):
    assert "hashpartitioning(doc_id" in Q.deva_articles(spark, SF)._jdf.queryExecution().executedPlan().toString()
