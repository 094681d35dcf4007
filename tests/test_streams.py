"""Streams that stop and go on: log tails by offset, and keyed passes with state."""

import hashlib
import os
import uuid

import pytest
from pyspark.sql import functions as F

from akshara.operators import articles as A
from akshara.plans import streams as P
from akshara.sources import logs
from akshara.streaming import articles as S


@pytest.fixture
def folder(spark):
    A.checkpoint_root(spark)
    return "/tmp/streams-" + uuid.uuid4().hex


def append(path, data):
    with open(path, "ab") as f:
        f.write(data)


@pytest.mark.parametrize("part", [1 << 20, 7])
def test_lines_come_once_whatever_is_appended(spark, folder, part):
    os.makedirs(f"{folder}/in")
    go = lambda: P.run_to_end(logs.tail_logs(spark, f"{folder}/in", ".log", part), f"{folder}/out", f"{folder}/state")
    read = lambda: [(r.log_name, r.line) for r in spark.read.schema(logs.SCHEMA).parquet(f"{folder}/out").orderBy("log_name", "at").collect()]
    append(f"{folder}/in/a.log", b"one\ntwo\r\n\nthr")
    append(f"{folder}/in/other.txt", b"no\n")
    go()
    assert read() == [("a.log", "one"), ("a.log", "two"), ("a.log", "")]
    append(f"{folder}/in/a.log", "ee é\nfour".encode())
    append(f"{folder}/in/b.log", b"x" * 100 + b"\n")
    go()
    go()
    append(f"{folder}/in/a.log", b"\n")
    go()
    assert read() == [("a.log", x) for x in ("one", "two", "", "three é", "four")] + [("b.log", "x" * 100)]


def test_a_shorter_file_is_read_again(spark, folder):
    os.makedirs(f"{folder}/in")
    append(f"{folder}/in/a.log", b"one\ntwo\n")
    go = lambda: P.run_to_end(logs.tail_logs(spark, f"{folder}/in"), f"{folder}/out", f"{folder}/state")
    go()
    with open(f"{folder}/in/a.log", "wb") as f:
        f.write(b"new\n")
    go()
    assert sorted(r.line for r in spark.read.schema(logs.SCHEMA).parquet(f"{folder}/out").collect()) == ["new", "one", "two"]


@pytest.mark.parametrize("read", [1 << 20, 5])
def test_every_cut_into_ranges_gives_all_lines(spark, folder, monkeypatch, read):
    monkeypatch.setattr(logs, "READ", read)
    os.makedirs(folder)
    data = b"a\n\nlonger line\n\r\nlast without end"
    append(f"{folder}/x", data)
    for part in (1, 2, 3, 5, 100):
        found = [r for p in logs.ranges("x", 0, len(data), part) for b in logs.lines_of(folder, p) for r in b.to_pylist()]
        assert [r["line"] for r in found] == ["a", "", "longer line", "", "last without end"]
        assert [r["at"] for r in found] == [0, 2, 3, 15, 17]
    assert logs.whole_lines(folder, "x", len(data)) == 17
    assert logs.sizes(f"{folder}/absent", "") == {}


def test_batch_read_takes_an_unfinished_line(spark, folder):
    os.makedirs(folder)
    append(f"{folder}/x.log", b"a\nb")
    assert sorted(r.line for r in logs.tail_logs(spark, folder, stream=False).collect()) == ["a", "b"]
    os.makedirs(f"{folder}/none")
    assert logs.tail_logs(spark, f"{folder}/none", stream=False).count() == 0


def steps(spark, folder, schema, batches, apply):
    """What comes through when the batches arrive one after another, each after a restart."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        P.run_to_end(apply(spark.readStream.schema(schema).parquet(f"{folder}/in")), f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out")


def test_first_of_each_key_and_all_without_one(spark, folder):
    batches = [[(2, "a"), (1, "a"), (3, ""), (3, ""), (4, None)], [(0, "a"), (5, "b"), (6, None)], [(7, "b"), (8, "")]]
    out = steps(spark, folder, "n long, k string", batches, lambda s: S.first_seen(s, "k", "n"))
    assert sorted((r.n, r.k or "") for r in out.collect()) == [(1, "a"), (3, ""), (3, ""), (4, ""), (5, "b"), (6, ""), (8, "")]


def test_address_pass_comes_before_title_pass(spark, folder):
    """A title counts once its page has passed the addresses."""
    batches = [[(1, "http://x.com/1", "One"), (2, "http://www.x.com/1/", "Two"), (3, "http://x.com/3", "one!")], [(4, "http://x.com/4", "Two"), (5, "http://x.com/3", "Three"), (6, "http://x.com/6", "")]]
    out = steps(spark, folder, "n long, url string, title string", batches, lambda s: S.pages_once(s, "url", "title", "n"))
    assert sorted(r.n for r in out.collect()) == [1, 4, 6]


def test_a_key_is_forgotten_behind_the_watermark(spark, folder):
    day = lambda d: f"2024-01-{d:02d} 00:00:00"
    batches = [[(1, "a", day(1))], [(2, "a", day(3)), (3, "b", day(9))], [(4, "b", day(9))], [(5, "a", day(10))]]
    batches = [[(n, k, t) for n, k, t in b] for b in batches]
    out = steps(spark, folder, "n long, k string, t string", batches, lambda s: S.first_seen(s.withColumn("time", F.to_timestamp("t")).withWatermark("time", "0 seconds"), "k", "n", "time", 4 * 86_400_000))
    assert sorted(r.n for r in out.collect()) == [1, 3, 5]


def test_lines_are_appended_at_their_places_whatever_task_has_them(spark, folder):
    """A broadcast join in place of a merge join left the rows of a log in several tasks, which wrote over one another."""
    rows = spark.range(0, 4000, 1, 16).select(F.format_string("%d.log", F.col("id") % 3).alias("log"), (F.col("id") % 2).cast("int").alias("step"), F.struct("id").alias("ord"), F.concat_ws(" ", F.col("id").cast("string"), F.sha2(F.col("id").cast("string"), 512)).alias("text"))
    limits = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "20k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        for step in range(2):
            P.append_logs(rows, folder, step)
    finally:
        for k in limits:
            spark.conf.unset(k)
    for log in range(3):
        ids = sorted((i for i in range(4000) if i % 3 == log), key=lambda i: (i % 2, i))
        with open(f"{folder}/{log}.log") as f:
            assert f.read() == "".join(f"{i} {hashlib.sha512(str(i).encode()).hexdigest()}\n" for i in ids)


def test_a_tailed_document_keeps_its_carriage_returns(spark, folder):
    texts = {-9: "a\r\nb", 1: "a\r\r\n\\r\n\r", 2: "\\r", 3: "x;\n;\n", 4: None, 17: "\u2028\r\u2028"}
    spark.createDataFrame([(i, "en", "s", t) for i, t in texts.items()], "doc_id long, lang string, source string, text string").write.parquet(f"{folder}/documents.parquet")
    found = {r.doc_id: r for r in P.log_tail(spark, folder).collect()}
    assert {i: (r.text_md5, r.lines, r.in_order) for i, r in found.items()} == {i: (hashlib.md5((t or "").encode()).hexdigest(), (t or "").count("\n") + 1, True) for i, t in texts.items()}
