"""Packing of tokenised documents into fixed windows by sum-of-squares placement.

A document's ids are cut into full windows and a remainder. Remainders arrive
online: each goes on top of an open window whose fill level makes the sum of
squared counts of partly filled windows smallest (or opens a window); an array
holds the count at each level. Levels then stay balanced, which keeps a partner
for every size. At the end of a partition its few open windows are laid end to
end and cut at the capacity, so that one window a partition is padded at most.

Every partition packs by itself: no shuffle, bounded memory, and a lost task
repeats with the same result, as a scan's partitions keep their rows and order.
Null and empty texts are documents of the end id alone. Rows of equal id are
separate documents.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from akshara.llm._bytes import blocks, released, utf8, words
from akshara.llm._frames import field

CAPACITY, END_ID = 2048, 1
#: Words whose ids a worker keeps, and the longest of them in bytes.
MEMO, MEMO_BYTES = 250_000, 48
PIECE = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")], T.StructField("ids", T.BinaryType())])
#: What ends a word's last token, and the words of a text as the vocabulary's tokenizer cuts them.
WORD_END = "</w>"
#: Classes of bytes: white space, letters, digits, other printable ASCII, and what only the whole tokenizer can treat.
BLANK, LETTER, DIGIT, OTHER, HARD = range(5)
CLASS = np.full(256, HARD, np.uint8)
CLASS[0x21:0x7F] = OTHER
CLASS[[0x20, 9, 10, 11, 12, 13]] = BLANK
CLASS[0x30:0x3A] = DIGIT
CLASS[0x41:0x5B] = CLASS[0x61:0x7B] = LETTER
CLASS[[0x27, 0x3C]] = HARD  # contractions, and marks of special tokens
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
EASY = re.compile(rb"[a-z]+|[0-9]|[!-&(-/:;=-@\[-`{-~]+")
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_tokenizers: dict[str, tuple] = {}


def _tokenizer(name: str):
    """The tokenizer of a file, or of a name among the public vocabularies, its model alone (for words that are cut already), the ids of words seen so far, and which ids end a word."""
    if name not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        path = name
        if not os.path.exists(path):
            import public_tokenizers

            path = public_tokenizers.path(name)
        tokenizer = Tokenizer.from_file(path)
        ends = np.zeros(tokenizer.get_vocab_size(), bool)
        ends[[i for t, i in tokenizer.get_vocab().items() if t.endswith(WORD_END)]] = True
        bare = Tokenizer(tokenizer.model)
        bare.pre_tokenizer = WhitespaceSplit()
        _tokenizers[name] = (tokenizer, bare, {}, ends)
    return _tokenizers[name]


def cut_ids(texts: list[str], count: list[int], tokenizer, ends: np.ndarray) -> list[bytes] | None:
    """Ids of each text: all are encoded as one, which is cut after as many word ends as each has words; None if that does not come out even."""
    ids = np.array(tokenizer.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0].ids, "<u4")
    stops = np.flatnonzero(ends[ids]) + 1
    if not texts or min(count) < 1 or len(stops) != sum(count):
        return None
    raw, last = ids.tobytes(), (4 * stops[np.cumsum(count, dtype=np.int64) - 1]).tolist()
    return [raw[a:b] for a, b in zip([0, *last], last, strict=False)]


def word_ids(new: list[bytes], tokenizer, bare, ends: np.ndarray) -> dict[bytes, bytes]:
    """Ids of words as split_words() cuts them."""
    easy = [w for w in new if EASY.fullmatch(w)]
    out = dict(zip(easy, cut_ids([w.decode() for w in easy], [1] * len(easy), bare, ends) or (), strict=False))
    hard = [w for w in new if w not in out]
    plain = [(w, w.decode()) for w in hard if b"<|" not in w]
    found = cut_ids([t for _, t in plain], [len(WORDS.findall(unicodedata.normalize("NFC", t).lower())) for _, t in plain], tokenizer, ends)
    out.update(zip((w for w, _ in plain), found or (), strict=False))
    rest = [w for w in new if w not in out]
    for w, e in zip(rest, tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False), strict=True):
        out[w] = np.array(e.ids, "<u4").tobytes()
    return out


def split_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of all rows as one binary array, and for each row the number of words before it.

    Between white space, runs of ASCII letters (lower-cased), single digits and
    runs of other signs are words, as the vocabulary's own rule has it; a run
    between white space that holds an apostrophe, "<", a control or a byte
    beyond ASCII stays whole and as it is.
    """
    kind = CLASS[buf]
    start, end, _ = words(buf, offsets)
    new = np.zeros(len(buf), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    solid = kind != BLANK
    new &= solid
    low = LOWER[buf]
    before = np.zeros(len(buf) + 1, np.int32)
    np.cumsum(kind == HARD, out=before[1:])
    hard = np.flatnonzero(before[end] > before[start])
    if len(hard):
        edge = np.zeros(len(buf) + 1, np.int8)
        edge[start[hard]] = 1
        np.add.at(edge, end[hard], -1)
        inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
        new[inside] = False
        low[inside] = buf[inside]
    new[start] = True
    first = np.flatnonzero(new)
    np.cumsum(solid, out=before[1:])
    at = np.append(before[first], before[-1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(at), pa.py_buffer(low[solid])]), np.searchsorted(first, offsets)


def token_ids(texts: pa.Array, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts (null: empty) as little-endian unsigned 32-bit numbers, and the texts' byte offsets there.

    The vocabulary's tokens never cross a word, so a text's ids are those of
    its words. Each distinct word of the texts is looked up once.
    """
    tokenizer, bare, memo, ends = _tokenizer(name)
    every, first = split_words(*utf8(texts))
    coded = every.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    new = [w for w in distinct if w not in memo]
    for i in range(0, len(new), 8192):
        memo.update(word_ids(new[i : i + 8192], tokenizer, bare, ends))
    ids = pa.array([memo[w] for w in distinct], pa.large_binary()).take(coded.indices)
    # the first words seen stay: frequent ones come early, and nothing is worked out again for having been put out
    room = MEMO - (len(memo) - len(new))
    for w in new:
        if len(w) > MEMO_BYTES or room <= 0:
            del memo[w]
        else:
            room -= 1
    if not len(ids):
        return np.zeros(0, np.uint8), first
    data = ids.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), np.frombuffer(ids.buffers()[1], np.int64)[ids.offset :][first]


class Levels:
    """Open windows by fill level; place() chooses where a piece goes."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: list[list] = [[] for _ in range(capacity + 1)]

    def place(self, size: int) -> int:
        """The level to put a piece on, 0 for a new window.

        Moving a window from level l to l + size changes the sum of squares by
        1 - 2 count[l], and by 1 + 2 count[l + size] if it is still open then.
        Ties go to the fullest window.
        """
        n, c = self.count, self.capacity
        gain = 2 * n[1 : c - size + 1] - 1
        cost = 2 * n[size + 1 : c + 1] + 1
        if len(cost):
            cost[-1] = 0
        change = np.where(gain > 0, cost - gain, 1 << 60)[::-1]
        if not len(change):
            return 0
        best = int(np.argmin(change))
        return c - size - best if change[best] <= 2 * n[size] + 1 else 0


def _pack(name: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 33
        levels, n_windows = Levels(capacity), 0
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols[:6]] + [pa.array(cols[6], pa.binary())], PIECE.names)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            _, offsets = utf8(batch.column(1))
            for i, j in blocks(offsets, 4 << 20):
                raw, at = token_ids(batch.column(1).slice(i, j - i), name)
                for k, doc in enumerate(ids[i:j]):
                    tokens = raw[at[k] : at[k + 1]].tobytes() + end
                    n = len(tokens) // 4
                    whole = n // capacity * capacity
                    for start in range(0, whole, capacity):
                        out.append((doc, start, capacity, n, base + n_windows, 0, tokens[4 * start : 4 * (start + capacity)]))
                        n_windows += 1
                    size = n - whole
                    if size:
                        level = levels.place(size)
                        if level:
                            window = levels.open[level].pop()
                            levels.count[level] -= 1
                        else:
                            window = (base + n_windows, [])
                            n_windows += 1
                        window[1].append((doc, whole, size, n, window[0], level, tokens[4 * whole :]))
                        if level + size == capacity:
                            out.extend(window[1])
                        else:
                            levels.open[level + size].append(window)
                            levels.count[level + size] += 1
                if len(out) >= 2000:
                    yield flush()
        fill = 0
        for level in range(capacity - 1, 0, -1):
            for _, pieces in levels.open[level]:
                for doc, start, size, n, _, _, tokens in pieces:
                    while size:
                        if not fill:
                            n_windows += 1
                        take = min(size, capacity - fill)
                        out.append((doc, start, take, n, base + n_windows - 1, fill, tokens[: 4 * take]))
                        fill = (fill + take) % capacity
                        start, size, tokens = start + take, size - take, tokens[4 * take :]
        yield flush()

    return run


def pack_documents(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start (its document's ids before it), length, doc_tokens, sequence_id, offset (in the sequence) and ids.

    ids are little-endian unsigned 32-bit numbers: those of the tokenizer and
    end_id at the end of each document. vocabulary: a tokenizer file, or the
    name of one of the public vocabularies. Other columns are not kept.
    """
    rows = docs.select(field(id_col).cast("long").alias("doc_id"), field(text_col).alias("text"))
    return rows.mapInArrow(released(_pack(vocabulary, capacity, end_id)), PIECE)
