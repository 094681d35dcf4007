import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from akshara.sources import arrays as AR
from akshara.sources import articles as SA


@pytest.fixture()
def texts():
    """Values whose strings hold what a cut must not fall for."""
    rng = random.Random(5)
    pieces = ['"', "\\", "\\\\\"", "[", "]", "{", "}", ",", ":", "न", "é", "\n", "articles", "x" * 40, ""]
    return [None, "", "\\" * 9, '"' * 7] + ["".join(rng.choices(pieces, k=rng.randrange(0, 30))) for _ in range(60)]


def held(spark, folder, **options):
    rows = AR.read_elements(spark, str(folder), **options).collect()
    return {n: [json.loads(r.element) for r in sorted(rows, key=lambda r: r.at) if r.name == n] for n in {r.name for r in rows}}


@pytest.mark.parametrize("part", [7, 64, 1 << 20])
def test_elements_of_cut_files_are_those_of_the_whole(spark, tmp_path, texts, part):
    rows = [{"title": t, "topics": [t, [t]], "n": {"m": i}} for i, t in enumerate(texts[:24])]
    files = {
        "bare.json": json.dumps(rows),
        "wide.json": "  " + json.dumps(rows, indent=3, ensure_ascii=False) + "\n\n",
        "object.json": json.dumps({"_meta": {"articles": [1, 2]}, "articles": rows, "more": [{"a": 1}]}),
        "last.json": json.dumps({"x\\\",\"articles": [8], "articles": rows}),
        "twice.json": '{"articles": [1, 2], "articles" : [3, 4]}',
        "scalars.json": '[1, "a,b", null , [2, 3], {"k": [4]}]',
    }
    none = {"none.json": "[]", "blank.json": " [ \n ]", "zero.json": "", "open.json": '[{"a": 1}', "string.json": '[{"a": "1}]', "more.json": "[1] [2]", "under.json": "[1]]", "other.json": '{"rows": [1]}', "no_array.json": '{"articles": {"a": 1, "b": 2}}', "scalar.json": "3"}
    for name, text in (files | none).items():
        (tmp_path / name).write_text(text)
    if part == 7:  # small cuts of the small files; large ones of these would be many ranges
        files = {n: files[n] for n in ("twice.json", "scalars.json")}
        for name in ("bare.json", "wide.json", "object.json", "last.json"):
            (tmp_path / name).unlink()
    want = {n: (lambda v: v["articles"] if isinstance(v, dict) else v)(json.loads(t)) for n, t in files.items()}
    assert held(spark, tmp_path, part=part) == want


def test_quotes_and_depths_by_hand(texts):
    for text in [json.dumps(texts), *(json.dumps([t]) for t in texts)]:
        data = np.frombuffer(text.encode(), np.uint8)
        want, inside, escaped = [], False, False
        for i, c in enumerate(data.tolist()):
            if c == AR.QUOTE and not escaped:
                want.append(i)
                inside = not inside
            escaped = c == AR.BACKSLASH and not escaped
        assert AR.quotes(data, 0).tolist() == want
        for cut in range(len(data)):
            before = len(text.encode()[:cut]) - len(text.encode()[:cut].rstrip(b"\\"))
            assert AR.quotes(data[cut:], before).tolist() == [w - cut for w in want if w >= cut]


def test_an_array_written_by_many_tasks_is_read_back(spark, tmp_path, texts):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path / "state"))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, title string").repartitionByRange(5, "i").sortWithinPartitions("i").checkpoint()
    size = AR.write_array(df, str(tmp_path / "out/a.json"))
    AR.write_array(df, str(tmp_path / "out/b.json"), "articles", {"run": 'a "b"'})
    AR.write_array(df.limit(0), str(tmp_path / "out/c.json"))
    want = [{"i": i, "title": t} for i, t in enumerate(texts)]
    assert (tmp_path / "out/a.json").stat().st_size == size
    assert json.loads((tmp_path / "out/a.json").read_text()) == want and json.loads((tmp_path / "out/c.json").read_text()) == []
    assert json.loads((tmp_path / "out/b.json").read_text()) == {"_meta": {"run": 'a "b"'}, "articles": want}
    assert held(spark, tmp_path / "out", part=100) == {"a.json": want, "b.json": want}
    assert not list((tmp_path / "out").glob("*.writing"))
    one = AR.read_elements(spark, str(tmp_path / "out/a.json"), part=200)
    assert one.select(F.spark_partition_id()).distinct().count() > 1


def test_a_file_with_a_malformed_article_holds_none(spark, tmp_path):
    (tmp_path / "good.json").write_text('[{"title": "a", "fact_score": "x"}, {"title": "b", "other": 1}]')
    (tmp_path / "bad.json").write_text('[{"title": "c"}, {"title": d}, {"title": "e"}]')
    (tmp_path / "number.json").write_text('[{"title": "f"}, 3]')
    rows = SA.read_articles(spark, str(tmp_path))
    assert sorted(r.title for r in rows.collect()) == ["a", "b"] and "__bad" not in rows.columns
    assert SA.read_articles(spark, str(tmp_path / "absent")).count() == 0
