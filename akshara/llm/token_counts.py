"""Token counts of whole texts under a byte-level pair vocabulary, by rank-synchronous merging of arrays.

The texts of a block are cut into pre-tokens by classes of their characters, all
at once. The distinct pre-tokens lie in one ragged array of symbols; each round
looks at every pre-token's pair of lowest rank and merges all its places in all
pre-tokens simultaneously (from the left where they overlap), until no pair of
the vocabulary is left; the symbols that survive are counted and added up by
document. That is what merging one pair at a time gives, since every merge of
the vocabulary makes a symbol of its own, so a pair that holds the symbol ranks
behind it; a vocabulary for which this fails is refused.

Every partition works by itself on blocks of bounded size; a very long text is
cut into blocks where a pre-token must begin. Null and empty texts have no
tokens. Rows of equal id are counted each. Columns of any name stay; n_bytes,
n_tokens and over_limit replace old ones of their names.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from akshara.llm._bytes import blocks, released, utf8
from akshara.llm._frames import rowed, unrowed

LIMIT = 1024
#: Bytes of text that are counted at a time.
WORK = 2 << 20
#: Classes of characters; those that Python's Unicode tables leave out are asked of the library.
OTHER, LETTER, NUMBER, BLANK, UNKNOWN = range(5)
# They must be these for equal results.
BLANKS = (9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
SHORT, LONG = b"stmd", (b"re", b"ve", b"ll")
#: Rank of a pair that the vocabulary lacks.
NONE = np.int32(1 << 30)
_vocabularies: dict[str, Vocabulary] = {}


def _byte_letters() -> dict[str, int]:
    """The printable characters that stand for the 256 bytes in a byte-level vocabulary: those printable in Latin-1 for themselves, the others in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """A tokenizer file: ranks of pairs of symbols, added tokens and classes of characters."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        odd = [k for k in ("unk_token", "dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd or spec["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError(f"{path} is not a plain byte-level pair vocabulary")
        self.added = [t["content"] for t in spec["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens that take white space or whole words")
        self.split = re.compile(b"|".join(re.escape(t.encode()) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        ids = model["vocab"]
        letters = _byte_letters()
        self.byte = np.zeros(256, np.int32)
        for letter, b in letters.items():
            self.byte[b] = ids[letter]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = np.array([ids[a + b] for a, b in pairs], np.int32)
        if len(np.unique(made)) != len(made) or np.isin(made, self.byte).any():
            raise ValueError(f"{path} makes one symbol by several merges")
        key = np.array([ids[a] for a, _ in pairs], np.int64) << 32 | np.array([ids[b] for _, b in pairs], np.int64)
        order = np.argsort(key)
        self.key, self.rank, self.made = key[order], order.astype(np.int32), made
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        first = {"L": LETTER, "N": NUMBER}
        category = unicodedata.category
        self.kind[:] = [UNKNOWN if (c := category(chr(i))) == "Cn" else first.get(c[0], OTHER) for i in range(0x110000)]
        self.kind[list(BLANKS)] = BLANK
        self.cutter = Tokenizer.from_file(path).pre_tokenizer

    def kinds(self, points: np.ndarray) -> np.ndarray:
        """Classes of characters; a new one is shown to the library between two characters of each class."""
        out = self.kind[points]
        if (out == UNKNOWN).any():
            for c in np.unique(points[out == UNKNOWN]).tolist():
                alone = lambda x, c=c: len(self.cutter.pre_tokenize_str(x + chr(c) + x)) == 1
                self.kind[c] = LETTER if alone("x") else NUMBER if alone("1") else OTHER if alone("!") else BLANK
            out = self.kind[points]
        return out

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NONE) if len(self.key) else np.full(len(key), NONE)


def vocabulary_of(name: str) -> Vocabulary:
    """The vocabulary of a file, or of a name among the public ones, kept by the process."""
    if name not in _vocabularies:
        path = name
        if not os.path.exists(path):
            import public_tokenizers

            path = public_tokenizers.path(name)
        _vocabularies[name] = Vocabulary(path)
    return _vocabularies[name]


def pre_tokens(buf: np.ndarray, cuts: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Byte positions at which pre-tokens start; none goes across a cut.

    Letters, numbers and other signs form runs, each with one space before it.
    White space before a run keeps its last character to itself, a space goes to
    the run. After an apostrophe that opens a token, s, t, m, d, re, ve and ll
    form a token with it.
    """
    n_bytes = len(buf)
    if not n_bytes:
        return np.zeros(0, np.int64)
    if buf.max() < 0x80:
        at, kind = np.arange(n_bytes), vocabulary.kinds(buf)
    else:
        at = np.flatnonzero((buf & 0xC0) != 0x80)
        kind = vocabulary.kinds(np.frombuffer(buf.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32))
    n = len(at)
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(at, cuts)] = True
    begins, ends = first[:-1], np.append(first[1:-1], True)
    blank, lead = kind == BLANK, buf[at]
    space = lead == 0x20
    before_space, before_blank = np.zeros(n, bool), np.zeros(n, bool)
    before_space[1:], before_blank[1:] = space[:-1], blank[:-1]
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    after_word = np.zeros(n, bool)
    after_word[:-1] = ~blank[1:]
    after_word &= ~ends  # a character that is not white space follows in the same text
    start = (change & (blank | ~before_space)) | (blank & before_blank & after_word)
    start |= begins
    mark = np.flatnonzero(lead == 0x27)
    if len(mark):
        opens = begins[mark] | ((kind[np.maximum(mark - 1, 0)] != OTHER) & ~before_space[mark])
        mark = mark[opens]
        wide = np.append(lead, np.zeros(3, np.uint8))  # a character beyond ASCII never equals these letters
        stop = np.append(begins, np.ones(3, bool))
        in1, in2 = ~stop[mark + 1], ~stop[mark + 1] & ~stop[mark + 2]
        one = in1 & np.isin(wide[mark + 1], np.frombuffer(SHORT, np.uint8))
        two = np.zeros(len(mark), bool)
        for a, b in LONG:
            two |= in2 & (wide[mark + 1] == a) & (wide[mark + 2] == b)
        start[mark] = True
        start[mark[one | two] + 1] = False
        for found, size in ((one, 2), (two & ~one, 3)):
            next_ = mark[found] + size
            start[next_[next_ < n]] = True
    return at[start]


def merged_sizes(data: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """How many symbols each byte string has after all merges."""
    out = np.diff(offsets).astype(np.int64)
    rows = np.flatnonzero(out > 1)
    if not len(rows):
        return out
    size = out[rows]
    start = np.cumsum(size) - size
    symbols = vocabulary.byte[data[np.repeat(offsets[rows] - start, size) + np.arange(size.sum())]]
    last = np.zeros(len(symbols), bool)
    last[start + size - 1] = True
    rank = np.full(len(symbols), NONE)
    inner = np.flatnonzero(~last)
    rank[inner] = vocabulary.ranks(symbols[inner], symbols[inner + 1])
    while True:
        low = np.minimum.reduceat(rank, start)
        done = low == NONE
        if done.any():
            out[rows[done]] = size[done]
            if done.all():
                return out
            live = np.repeat(~done, size)
            symbols, rank, last = symbols[live], rank[live], last[live]
            rows, size, low = rows[~done], size[~done], low[~done]
            start = np.cumsum(size) - size
        hit = np.flatnonzero(rank == np.repeat(low, size))
        # of overlapping places of one pair every other one merges, from the left
        fresh = np.ones(len(hit), bool)
        fresh[1:] = hit[1:] != hit[:-1] + 1
        if not fresh.all():
            head = np.flatnonzero(fresh)
            hit = hit[(np.arange(len(hit)) - np.repeat(head, np.diff(np.append(head, len(hit))))) % 2 == 0]
        symbols[hit] = vocabulary.made[rank[hit]]
        last[hit] = last[hit + 1]
        gone = np.zeros(len(symbols), bool)
        gone[hit + 1] = True
        size -= np.add.reduceat(gone.astype(np.int64), start)
        start = np.cumsum(size) - size
        moved = hit - np.arange(len(hit))  # where the merged symbols are once the others are gone
        keep = ~gone
        symbols, rank, last = symbols[keep], rank[keep], last[keep]
        # only pairs with a merged symbol change
        near = np.zeros(len(symbols), bool)
        near[moved] = True
        near[np.maximum(moved - 1, 0)] = True
        touched = np.flatnonzero(near & ~last)
        rank[moved] = NONE
        rank[touched] = vocabulary.ranks(symbols[touched], symbols[touched + 1])


def token_counts(buf: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """How many tokens each text has."""
    n = len(offsets) - 1
    out = np.zeros(n, np.int64)
    cuts, special = offsets, np.zeros((0, 2), np.int64)
    raw = buf.tobytes() if vocabulary.split else b""
    if vocabulary.split and vocabulary.split.search(raw):
        found = [(a + m.start(), a + m.end()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for m in vocabulary.split.finditer(raw[a:b])]
        special = np.array(found, np.int64).reshape(-1, 2)
        cuts = np.unique(np.concatenate([offsets, special.ravel()]))
        out += np.bincount(np.searchsorted(offsets, special[:, 0], side="right") - 1, minlength=n)
    start = pre_tokens(buf, cuts[cuts < len(buf)], vocabulary)
    if not len(start):
        return out
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(np.append(start, len(buf)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(buf))])
    coded = words.dictionary_encode()
    sizes = merged_sizes(*utf8(coded.dictionary), vocabulary)[coded.indices.to_numpy()]
    if len(special):
        place = np.searchsorted(special[:, 0], start, side="right") - 1
        sizes[(place >= 0) & (start < special[np.maximum(place, 0), 1])] = 0
    return out + np.bincount(np.searchsorted(offsets, start, side="right") - 1, weights=sizes, minlength=n).astype(np.int64)


def stretches(buf: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """A long text in parts of about size bytes, cut before spaces behind printable ASCII, where a pre-token starts whatever surrounds them."""
    begin = 0
    while len(buf) - begin > size:
        at, cut = begin + size, 0
        while at < len(buf) and not cut:
            part = buf[at - 1 : at + size]
            found = np.flatnonzero((part[1:] == 0x20) & (part[:-1] > 0x20) & (part[:-1] < 0x7F))
            cut = at + int(found[0]) if len(found) else 0
            at += size
        if not cut:
            break
        yield buf[begin:cut]
        begin = cut
    yield buf[begin:]


def _count(name: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(name)
        for batch in batches:
            row = batch.column("row")
            buf, offsets = utf8(pc.struct_field(row, text_col))
            counts = np.zeros(len(row), np.int64)
            for i, j in blocks(offsets, WORK):
                part = buf[offsets[i] : offsets[j]]
                if len(part) > 2 * WORK:
                    counts[i] = sum(int(token_counts(s, np.array([0, len(s)]), vocabulary)[0]) for s in stretches(part, WORK))
                else:
                    counts[i:j] = token_counts(part, offsets[i : j + 1] - offsets[i], vocabulary)
            yield pa.RecordBatch.from_arrays([row, pa.array(np.diff(offsets)), pa.array(counts)], ["row", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """All columns of docs and n_bytes (UTF-8), n_tokens and over_limit (more than limit tokens).

    vocabulary: a byte-level pair tokenizer file, or the name of one of the
    public vocabularies. Its added tokens count where texts hold their strings,
    as the library has it; none is added.
    """
    rows = rowed(docs)
    out = rows.mapInArrow(released(_count(vocabulary, text_col)), T.StructType([rows.schema["row"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]))
    return unrowed(out.withColumn("over_limit", F.col("n_tokens") > limit), docs.columns, ["n_bytes", "n_tokens", "over_limit"])
