"""Run summaries, settings that differ, fingerprints and stale stages."""

import duckdb
import pytest

from akshara.operators import runs as R
from akshara.plans import runs as plans
from akshara.plans import streams

SF = "/root/testdata/sf0.001"


def test_summaries(spark):
    rows = [("a", "x" * 10, 70, True, "s", None), ("a", "x" * 30, 81, False, "s", None), ("a", None, None, None, "", "Z"), ("b", "", None, None, None, None)]
    df = spark.createDataFrame(rows, "run string, body string, coverage_score int, gates_passed boolean, source string, zone_code string")
    got = {r.run: (r.articles, r.median_body, r.coverage_score, r.fact_score, r.gates_failed, r.sources) for r in R.run_summary(df).collect()}
    assert got == {"a": (3, 10, 75.5, None, 1, 2), "b": (1, 0, None, None, 0, 1)}
    assert R.run_summary(df.limit(0)).count() == 0


def test_newest_runs_and_settings_that_differ(spark):
    rows = [("x", 1, {"a": "0", "b": "1"}), ("x", 2, {"a": "1", "b": "1", "c": None}), ("y", 1, {"a": "1", "b": "2"}), ("z", 5, {"a": "1", "b": "1", "c": "3"})]
    runs = R.newest_run(spark.createDataFrame(rows, "label string, n int, config map<string,string>"), "label", "n")
    assert sorted((r.label, r.n) for r in runs.collect()) == [("x", 2), ("y", 1), ("z", 5)]
    got = {r.key: [tuple(s) for s in r.settings] for r in R.config_differences(runs, "label", "config").collect()}
    assert got == {"b": [("x", "1"), ("y", "2"), ("z", "1")], "c": [("x", None), ("z", "3")]}
    assert R.config_differences(runs.where("label = 'x'"), "label", "config").count() == 0


def test_fingerprints(spark):
    rows = [(1, "a", [1]), (2, None, None), (2, None, None), (3, "", [])]
    of = lambda r, n=1, cols="n int, t string, a array<int>": R.fingerprint(spark.createDataFrame(r, cols).repartition(n)).first().fingerprint
    assert of(rows) == of(rows[::-1], 3)
    assert R.fingerprint(spark.createDataFrame(rows, "n int, t string, a array<int>").select("a", "t", "n")).first().fingerprint == of(rows)
    others = [rows[:3], [*rows, rows[0]], [(1, "a", [1]), (2, "", None), (2, None, None), (3, "", [])], [(1, "a", [1]), (2, None, None), (3, "", []), (3, "", [])]]
    assert len({of(rows), *map(of, others)}) == 5
    assert of([]) == "0-0-0"
    pair = "t string, u string"
    assert of([("1:a", "b")], cols=pair) != of([("1", ":ab")], cols=pair)


@pytest.mark.parametrize("change,want", [({}, {}), ({"docs": "2"}, {"kept": ("docs", 1), "titles": ("kept", 2), "report": ("titles", 3)}), ({"labels": None}, {"report": ("labels", 1)}), ({"titles": "9"}, {"report": ("titles", 1)})])
def test_stale_stages(spark, change, want):
    first = {"docs": "1", "labels": "1", "kept": "1", "titles": "1", "report": "1", "other": "1"}
    table = lambda d: spark.createDataFrame([(k, v) for k, v in d.items() if v], "name string, fingerprint string")
    seen = R.manifest({"kept": ["docs"], "titles": ["kept"], "report": ["titles", "labels"], "loose": ["other"]}, table(first))
    got = {r.stage: (r.because, r.depth) for r in R.stale_stages(seen, table(first | change)).collect()}
    assert got == want


@pytest.mark.parametrize("module,name", [(m, n) for m in (plans, streams) for n in m.NAMES])
def test_against_sql(spark, module, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "events", "labels", "conversations"):
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = module.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = db.sql(f"select {', '.join(cols)} from ({module.oracle_sql()[name]})").fetchall()
    assert sorted(str(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(map(str, want))
