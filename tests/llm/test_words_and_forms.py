"""Spelling variants, token counts and fill-in-the-middle forms against brute force and on odd rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from akshara.llm import fill_in_middle as M
from akshara.llm import spelling_variants as S
from akshara.llm import token_counts as TC
from akshara.llm import queries as Q

LETTERS = list("abcdeé")
SCHEMA = "doc_id long, text string, row string, n int, `word` string, `a.b` int, h array<int>"


def prose(seed, n, letters=LETTERS, low=4, high=8):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(letters, rng.integers(low, high))) for _ in range(n))


TEXTS = [None, "", " \n\t", "x", "<", "<P>", "a<S>b", "<<M>x", "é" * 700, "👍🏽 naïve Ünï ×÷ don't it's 'S", "ab " * 400, prose(1, 900), "tail <|endoftext|> of<|endoftext|>", prose(2, 300, list("<PSM> é"), 1, 9), prose(3, 60)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "r", 1, "w", i, [1]) for i, t in enumerate(TEXTS)]
    rows += [(3, "x", "r", 1, "w", 3, None), (None, TEXTS[11], None, None, None, None, None), (None, TEXTS[11], None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# spelling variants


def brute_words(rows, typos=97):
    seen = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            seen[w[: h % len(w)] + w[h % len(w) + 1 :] if h % typos == 0 else w] += 1
    return {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_variants(words, ratio=2):
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and distance(v, w) == 1] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out


def test_words_of_a_corpus(docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for typos in (97, 5):
        got = {r.word: r.n for r in S.corpus_words(docs, typos=typos).collect()}
        assert got == brute_words(rows, typos)
    assert S.corpus_words(empty).count() == 0
    assert S.variants_of_documents(empty).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert S.variants_of_documents(empty).count() == 0


@pytest.mark.parametrize("shard,hot", [(20_000, 10_000), (40, 5)])
def test_variants_against_all_pairs(spark, shard, hot):
    """Words of few letters, so that halves are shared by many; small shards split their segments."""
    rng = np.random.default_rng(5)
    words = {}
    for _ in range(400):
        w = "".join(rng.choice(list("abé"), rng.integers(5, 10)))
        words[w] = int(rng.integers(3, 60))
    words |= {"aaaaa": 9, "aaaaaa": 90, "aaaaaaa": 900, "abaab": 7, "x" * 60: 5, "x" * 61: 11, "x" * 30 + "y" + "x" * 30: 3}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    out = [tuple(r) for r in S.spelling_variants(df, shard=shard, hot=hot).collect()]
    assert len(out) == len(words)
    assert set(out) == brute_variants(words)


def test_variants_of_documents(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert {tuple(r) for r in S.variants_of_documents(docs).collect()} == brute_variants(brute_words(rows))


def test_ratio_must_grow(docs):
    with pytest.raises(ValueError):
        S.spelling_variants(S.corpus_words(docs), ratio=1)


# token counts


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def library_counts(library, texts):
    return [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


PARTS = ["'", "s", "t", "re", "ve", "ll", "m", "d", " ", "  ", "\n", "\t", "\xa0", "　", "a", "B", "é", "1", "२", "²", "!", "...", "<|endoftext|>", "<|endof", "中", "Ᲊ", "\U00010d40", "\U000105c0", "\x1c", "\x85", "​", "'S", "aaaa", "zz", "==", "\U0001f44d\U0001f3fd"]


def test_counts_equal_the_librarys(library):
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(PARTS, rng.integers(0, 40))) for _ in range(4000)]
    texts += ["a" * 5000, "ab" * 3000, " " * 3000, "é" * 999, "=" * 4097, "", "<|endoftext|>" * 5]
    vocabulary = TC.vocabulary_of("byte_bpe_50k.json")
    assert TC.token_counts(*TC.utf8(pa.array(texts)), vocabulary).tolist() == library_counts(library, texts)
    long = "".join(texts)
    for size in (50, 1000):
        parts = list(TC.stretches(np.frombuffer(long.encode(), np.uint8), size))
        assert sum(int(TC.token_counts(p, np.array([0, len(p)]), vocabulary)[0]) for p in parts) == library_counts(library, [long])[0]
        assert len(parts) > len(long) / size / 10


def test_merging_equals_one_pair_at_a_time():
    vocabulary = TC.vocabulary_of("byte_bpe_50k.json")
    rank = {(int(k) >> 32, int(k) & 0xFFFFFFFF): (int(r), int(vocabulary.made[r])) for k, r in zip(vocabulary.key, vocabulary.rank, strict=True)}
    rng = np.random.default_rng(4)
    words = [bytes(rng.choice(list(b" abcehilnorstt\xc3\xa9"), rng.integers(1, 30)).astype(np.uint8)) for _ in range(500)] + [b"a" * k for k in range(1, 20)]

    def slow(word):
        s = vocabulary.byte[list(word)].tolist()
        while True:
            best = min(((rank[p][0], i) for i, p in enumerate(zip(s, s[1:], strict=False)) if p in rank), default=None)
            if best is None:
                return len(s)
            i = best[1]
            s[i : i + 2] = [rank[s[i], s[i + 1]][1]]

    assert TC.merged_sizes(*TC.utf8(pa.array(words, pa.binary())), vocabulary).tolist() == [slow(w) for w in words]


def test_token_counts(library, docs, empty, monkeypatch):
    monkeypatch.setattr(TC, "WORK", 1000)
    out = TC.count_tokens(docs, limit=100)
    assert out.columns == ["doc_id", "text", "row", "n", "word", "a.b", "h", "n_bytes", "n_tokens", "over_limit"]
    rows = out.collect()
    assert len(rows) == len(TEXTS) + 3
    for r, n in zip(rows, library_counts(library, [r.text for r in rows]), strict=True):
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 100)
    assert TC.count_tokens(empty).count() == 0


def test_other_kinds_of_vocabulary_are_refused():
    with pytest.raises(ValueError):
        TC.vocabulary_of("word_bpe_49k.json")


# fill in the middle


def brute_form(doc, text, seed=1):
    t = text or ""
    x = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    if not t or any(m in t for m in M.MARKS) or h[2] % 100 >= 90:
        return (len(t), "plain", None, None, t)
    if h[3] % 100 < 20:
        return (len(t), "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}")
    return (len(t), "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}")


@pytest.mark.parametrize("piece,chunk", [(M.PIECE, M.CHUNK), (40, 7)])
def test_fill_in_middle(docs, empty, piece, chunk):
    """Whole texts in their rows' tasks, and texts in pieces that cut code points and marks."""
    for seed in (1, 2, 3):
        out = M.fill_in_middle(docs, seed=seed, piece=piece, chunk=chunk).withColumn("again", M.restored(F.col("output"), F.col("form")))
        assert out.columns == ["doc_id", "text", "row", "word", "a.b", "h", "n", "form", "prefix_chars", "middle_chars", "output", "again"]
        rows = out.collect()
        assert len(rows) == len(TEXTS) + 3
        for r in rows:
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute_form(r.doc_id, r.text, seed)
            assert r.again == (r.text or "")
    assert M.fill_in_middle(empty, piece=piece).count() == 0


def test_word_units(docs):
    out = M.fill_in_middle(docs, unit="word", plain_share=0, spm_share=50, piece=64, chunk=5).withColumn("again", M.restored(F.col("output"), F.col("form")))
    for r in out.collect():
        starts = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", r.text or "")]
        assert r.n == len(starts) and r.again == (r.text or "")
        if r.form == "psm":
            cuts = [*starts, len(r.text)]
            assert r.output.startswith("<P>" + r.text[: cuts[r.prefix_chars]] + "<S>")
            assert r.output.endswith("<M>" + r.text[cuts[r.prefix_chars] : cuts[r.prefix_chars + r.middle_chars]])


def test_composition_of_chunks():
    """Any cut into chunks gives the functions and counts that reading byte by byte gives, from every state."""
    rng = np.random.default_rng(6)
    for unit in M.UNITS:
        machine = M.automaton(unit, M.MARKS)
        texts = ["".join(rng.choice(list("<PSM>é \n"), rng.integers(0, 90))).encode() for _ in range(40)]
        buf, offsets = M.utf8(pa.array(texts, pa.binary()))
        for chunk in (1, 4, 1000):
            state, units, _ = M.scan(buf, offsets, machine, chunk=chunk)
            for i, t in enumerate(texts):
                for s in range(machine.states):
                    at, n = s, 0
                    for b in t:
                        n += machine.emits[at, machine.of_byte[b]]
                        at = machine.next[at, machine.of_byte[b]]
                    assert (state[s, i], units[s, i]) == (at, n)


def test_marks_that_could_arise_at_a_joint_are_refused():
    for marks in (("aa", "b", "c"), ("<P>", ">P", "x"), ("", "a", "b"), ("a", "a", "b")):
        with pytest.raises(ValueError):
            M.Automaton("char", marks)


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op13_fill_in_middle"])
def test_against_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    db.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = db.execute(Q.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = Q.queries()[name](spark, "/root/testdata/sf0.001").select(*names)
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in got.collect())


def test_query_of_token_counts(spark, library):
    out = Q.op12_token_counts(spark, "/root/testdata/sf0.001")
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    rows = out.join(texts, "doc_id").collect()
    assert len(rows) == texts.count()
    assert [r.n_tokens for r in rows] == library_counts(library, [r.text for r in rows])
