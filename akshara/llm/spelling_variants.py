"""Spelling variants of a corpus's words, grouped by automata over the halves of words.

Words that differ by one inserted, deleted or replaced code point share a whole
half: the edit lies in one of the two segments of a word, so the other one stands
unharmed at the start or at the end of its neighbour. Automaton shards hold both
segments of every word. Every word is scanned by the shards that can hold a
segment of a compatible length from its start or its end; where a segment is
found at the right offset, what is left of both words is compared by its single
deletions, so that a group of words with one segment costs its size and not its
square. A pair that both segments find counts through the first.

A segment that more than HOT words have is split over several shards by those
words; the words to be scanned then go to each of them. A shard's held words
arrive before the scanned ones, so a task holds one shard's words at a time.

Null texts have no words; a null id counts as an empty number. Rows of equal id
and text count each. Extra columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from akshara.llm._bytes import blocks, released, utf8
from akshara.llm._frames import checkpointed, field

#: Code points of a word and times it must occur, and how often its form occurs for each time.
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
#: One in so many words of a document loses a code point (0: none).
TYPOS = 97
#: Segments a shard holds, about; words of one segment beyond which it is split.
SHARD, HOT = 20_000, 10_000
#: Bytes of text that are counted at a time.
WORK = 4 << 20
LETTERS = np.zeros(256, bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Lead byte of the code points from U+00C0 to U+00FF.
LEAD = 0xC3


def runs(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of maximal runs [A-Za-z\\u00C0-\\u00FF]+ of each text."""
    n = len(buf)
    inside = LETTERS[buf] | (buf == LEAD)
    inside[1:] |= buf[:-1] == LEAD
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    return np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:])) + 1


def counted(ids: list[int | None], buf: np.ndarray, offsets: np.ndarray, typos: int = TYPOS, least: int = LEAST_LENGTH) -> tuple[list[bytes], np.ndarray]:
    """The words of some texts and how often each occurs; a word may come twice."""
    low = LOWER[buf]
    start, end = runs(buf, offsets)
    points = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(buf != LEAD, out=points[1:])
    long = points[end] - points[start] >= least  # a deletion only shortens
    start, end = start[long], end[long]
    size = end - start
    if not len(start):
        return [], np.zeros(0, np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    data = low[np.repeat(start - at[:-1], size) + np.arange(at[-1])]
    coded = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
    words = coded.dictionary.to_pylist()
    owner = np.searchsorted(offsets, start, side="right") - 1
    both, n = np.unique(owner * len(words) + coded.indices.to_numpy(), return_counts=True)
    owner, code = both // len(words), both % len(words)
    if not typos:
        return words, np.bincount(code, weights=n, minlength=len(words)).astype(np.int64)
    heads = [zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids]
    crc = zlib.crc32
    h = np.fromiter((crc(words[c], heads[o]) for o, c in zip(owner.tolist(), code.tolist(), strict=True)), np.int64, len(code))
    odd = np.flatnonzero(h % typos == 0)
    total = np.bincount(code, weights=n, minlength=len(words)).astype(np.int64)
    np.subtract.at(total, code[odd], n[odd])
    other: dict[bytes, int] = defaultdict(int)
    for k in odd.tolist():
        w = words[code[k]].decode()
        i = int(h[k]) % len(w)
        other[(w[:i] + w[i + 1 :]).encode()] += int(n[k])
    return words + list(other), np.concatenate([total, np.array(list(other.values()), np.int64)])


def _counted(typos: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc").to_pylist()
            buf, offsets = utf8(batch.column("text"))
            for i, j in blocks(offsets, WORK):
                words, n = counted(ids[i:j], buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], typos, least)
                found = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(n)], ["word", "n"])
                yield found.filter(pc.and_(pc.greater(found["n"], 0), pc.greater_equal(pc.utf8_length(found["word"]), least)))

    return run


def corpus_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", typos: int = TYPOS, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n of the words of all texts; one in typos words of a document, chosen by the crc32 of id and word, loses a code point first."""
    rows = docs.select(field(id_col).alias("doc"), field(text_col).alias("text"))
    counts = rows.mapInArrow(released(_counted(typos, least_length)), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def segments(word: Column) -> list[tuple[Column, Column]]:
    """side (0: from the start, 1: from the end) and text of a word's two halves."""
    half = F.floor(F.length(word) / 2).cast("int")
    return [(F.lit(0), F.left(word, half)), (F.lit(1), F.right(word, F.length(word) - half))]


def neighbour_segments(word: Column) -> Column:
    """What segments of a word one edit away may be: its starts and ends of the lengths that halves of words shorter or longer by one, or as long, have."""
    n = F.length(word)
    half = lambda k: F.floor((n + k) / 2).cast("int")
    starts = F.array_distinct(F.array(half(-1), half(0), half(1)))
    ends = F.array_distinct(F.array(*[(n + k - half(k)).cast("int") for k in (-1, 0, 1)]))
    both = F.concat(F.transform(starts, lambda k: F.struct(F.lit(0).alias("side"), F.left(word, k).alias("part"))), F.transform(ends, lambda k: F.struct(F.lit(1).alias("side"), F.right(word, k).alias("part"))))
    return F.filter(both, lambda s: F.length(s["part"]) > 0)


def deletions(s: str) -> set[tuple[int, str]]:
    return {(i, s[:i] + s[i + 1 :]) for i in range(len(s))}


class Shard:
    """An automaton over the segments of held words; near() gives the held words one edit away from a scanned one."""

    def __init__(self):
        #: For each side and segment: the rests of held words as they are, with one code point less, and with one place open.
        self.rests: dict[tuple[int, str], tuple[dict, dict, dict]] = {}
        self.machine = None

    def hold(self, word: str, side: int) -> None:
        half = len(word) // 2
        part, rest = (word[half:], word[:half]) if side else (word[:half], word[half:])
        whole, shorter, opened = self.rests.setdefault((side, part), ({}, defaultdict(list), defaultdict(list)))
        whole[rest] = word
        for s in {s for _, s in deletions(rest)}:
            shorter[s].append(word)
        for key in deletions(rest):
            opened[key].append(word)

    def close(self) -> None:
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for part in {p for _, p in self.rests}:
            self.machine.add_word(part, part)
        if len(self.machine):
            self.machine.make_automaton()

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """Held words one edit away, with the side of the segment that finds them."""
        if not len(self.machine):
            return
        for stop, part in self.machine.iter(word):
            # offset: a first half stands at the start, a second half at the end
            for side, fits in ((0, stop + 1 == len(part)), (1, stop + 1 == len(word))):
                group = self.rests.get((side, part)) if fits else None
                if group:
                    rest = word[: len(word) - len(part)] if side else word[len(part) :]
                    whole, shorter, opened = group
                    found = {w for s in {s for _, s in deletions(rest)} if (w := whole.get(s))}
                    found.update(shorter.get(rest, ()))
                    for key in deletions(rest):
                        found.update(opened.get(key, ()))
                    for w in found:
                        # one edit exactly, and once a pair: the second half does not count where the first fits too
                        if w != word and not (side and word.startswith(w[: len(w) // 2]) and one_edit(w[len(w) // 2 :], word[len(w) // 2 :])):
                            yield w, side


def one_edit(a: str, b: str) -> bool:
    """Whether one code point inserted, deleted or replaced makes b of a."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, held words first."""
    at, shard = None, Shard()
    for batch in batches:
        out: tuple[list, list, list] = ([], [], [])
        for name, role, word, n, side in zip(*[batch.column(c).to_pylist() for c in ("shard", "role", "word", "n", "side")], strict=True):
            if name != at:
                at, shard = name, Shard()
            if role == 0:
                shard.hold(word, side)
                continue
            if shard.machine is None:
                shard.close()
            for held, _ in shard.near(word):
                out[0].append(held)
                out[1].append(word)
                out[2].append(n)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["word", "near", "near_n"])


def near_words(words: DataFrame, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """word, near and near_n: every pair of words one edit apart, in both directions; words: word (distinct) and n."""
    n_shards = max(1, -(-2 * words.count() // shard))
    held = words.select("word", "n", F.explode(F.array(*[F.struct(s.cast("int").alias("side"), p.alias("part")) for s, p in segments(F.col("word"))])).alias("s")).select("word", "n", "s.side", "s.part")
    # at most 2 * words / hot segments
    heavy = held.groupBy("side", "part").agg(F.count("*").alias("c")).where(F.col("c") > hot).select("side", "part", F.ceil(F.col("c") / hot).cast("int").alias("split"))
    held = held.join(F.broadcast(heavy), ["side", "part"], "left")
    scanned = words.select("word", "n", F.explode(neighbour_segments(F.col("word"))).alias("s")).select("word", "n", "s.side", "s.part").join(F.broadcast(heavy), ["side", "part"], "left")
    splits = F.coalesce("split", F.lit(1))
    held = held.select(F.pmod(F.xxhash64("side", "part", F.pmod(F.xxhash64("word"), splits)), F.lit(n_shards)).alias("shard"), F.lit(0).alias("role"), "word", "n", "side")
    scanned = scanned.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), splits.cast("long") - 1)))
    # a word goes once to a shard, whatever number of its segments may be there
    scanned = scanned.select(F.pmod(F.xxhash64("side", "part", "salt"), F.lit(n_shards)).alias("shard"), F.lit(1).alias("role"), "word", "n", F.lit(0).alias("side")).distinct()
    rows = held.unionByName(scanned)
    return rows.repartition("shard").sortWithinPartitions("shard", "role").mapInArrow(released(_scan), "word string, near string, near_n long")


def spelling_variants(words: DataFrame, ratio: float = RATIO, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word; words: word (distinct) and n.

    A word's form is its most frequent near word (the smallest of equal ones) if
    that occurs ratio times as often, at least; its root is where following
    forms ends. Counts grow along a chain by the ratio (above 1), so chains are
    short and their ends are found by doubling steps.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1")
    words = checkpointed(words.select("word", "n"))
    best = near_words(words, shard, hot).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("k"), F.col("near"))).alias("b"))
    rows = words.join(best, "word", "left")
    fits = -F.col("b.k") >= F.col("n") * ratio
    rows = checkpointed(rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("b.near")).alias("form"), F.when(fits, -F.col("b.k")).alias("form_n")))
    step = rows.where("form is not null").select("word", F.col("form").alias("to"))
    while True:
        on = step.select(F.col("word").alias("to"), F.col("to").alias("further"))
        found = checkpointed(step.join(on, "to", "left").select("word", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")))
        step = found.select("word", "to")
        if found.where("moved").isEmpty():
            break
    out = rows.join(step, "word", "left")
    return out.select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def variants_of_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """spelling_variants() of the words of all texts."""
    return spelling_variants(corpus_words(docs, id_col, text_col))
