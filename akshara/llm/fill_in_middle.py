"""Fill-in-the-middle forms of documents, cut by a parallel automaton scan.

One small automaton reads a text's bytes: it says where units (code points, or
words) begin and remembers whether a mark of the output format occurs. A text
is cut into chunks at any byte. All chunks are read side by side from every
state at once, so a chunk yields a function from its entry state to its exit
state and a count of units for each entry state. Composing the functions of
neighbours, which is associative, gives every chunk's true entry state and the
units before it; a cut then lies in one known chunk, which alone is read again.

A text of up to PIECE bytes is scanned in the task that has its row. A longer
one is dealt to tasks in pieces; each sends its function and counts, a fold over
a text's pieces (at most 2**31 / PIECE) finds their entry states, and the pieces
with a cut are looked at once more. Results are equal for every size of piece
and chunk.

Null texts are empty; empty texts are plain. Rows of equal id are transformed
alike, each by itself; a null id counts as an empty number. Columns of any name
stay; new columns replace old ones of their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from akshara.llm._bytes import blocks, released, utf8
from akshara.llm._frames import field, rowed, unrowed

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Bytes of a text beyond which it is dealt to tasks in pieces of that size, of a chunk, and of the block that a task reads at a time.
PIECE, CHUNK, WORK = 4 << 20, 256, 1 << 20
UNITS = ("char", "word")
CUT = T.StructType([T.StructField("n", T.LongType()), T.StructField("marked", T.BooleanType()), T.StructField("left", T.LongType()), T.StructField("right", T.LongType())])


class Automaton:
    """Classes of bytes, next state and units begun for each state and class. State 0 is the start; found: the states in which a mark has been seen."""

    def __init__(self, unit: str, marks: tuple[str, ...]):
        if unit not in UNITS:
            raise ValueError(f"unit must be one of {list(UNITS)}, got {unit!r}")
        raw = [m.encode() for m in marks]
        # else a mark could arise where a part and a mark meet
        if not all(raw) or len(set(raw)) < len(raw) or any(a.endswith(b[:k]) for a in raw for b in raw for k in range(1, len(b) + (a != b))):
            raise ValueError(f"marks must have characters, and no end of one may begin another: {list(marks)}")
        # the prefixes of marks are states; a byte leads to the longest one that ends there, a whole mark to the last state for good
        known = sorted({m[:k] for m in raw for k in range(len(m))}, key=lambda p: (len(p), p))
        place = {p: i for i, p in enumerate(known)}
        end = len(known)
        inside = lambda p: any(p.endswith(m) for m in raw)
        step = lambda p, b: end if inside(p + b) else next(place[(p + b)[k:]] for k in range(len(p) + 2) if (p + b)[k:] in place)
        spoken = sorted({b for m in raw for b in m})
        blank = frozenset(b" \t\n\v\f\r") if unit == "word" else frozenset()
        kind = lambda b: (b if b in spoken else -1, 0x80 <= b < 0xC0, b in blank)
        kinds = sorted({kind(b) for b in range(256)})
        self.of_byte = np.array([kinds.index(kind(b)) for b in range(256)], np.uint8)
        example = [next(b for b in range(256) if kind(b) == k) for k in kinds]
        # words: the states twice, between words and within one
        layers = 2 if unit == "word" else 1
        self.states, self.classes = (end + 1) * layers, len(kinds)
        self.next = np.zeros((self.states, self.classes), np.uint8)
        self.emits = np.zeros((self.states, self.classes), np.int32)
        for s in range(self.states):
            mark, within = s % (end + 1), s // (end + 1)
            for c, b in enumerate(example):
                to = end if mark == end else step(known[mark], bytes([b]))
                word = unit == "word" and b not in blank
                self.next[s, c] = to + (end + 1) * word
                self.emits[s, c] = (word and not within) if unit == "word" else not 0x80 <= b < 0xC0
        self.found = np.arange(self.states) % (end + 1) == end

    def steps(self, buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Byte after byte of chunks that stand in the order of their lengths, the longest first: how many bytes came before, and the classes of the chunks that still have one."""
        size = stop - start
        for k in range(int(size.max(initial=0))):
            m = int(np.searchsorted(-size, -k))
            yield k, self.of_byte[buf[start[:m] + k]]

    def read(self, buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every state and chunk: the exit state and the units begun."""
        order = np.argsort(start - stop, kind="stable")
        state = np.repeat(np.arange(self.states)[:, None], len(start), axis=1)
        units = np.zeros((self.states, len(start)), np.int64)
        to, emits = self.next.ravel().astype(np.int64), self.emits.ravel()
        for _, kinds in self.steps(buf, start[order], stop[order]):
            key = state[:, : len(kinds)] * self.classes + kinds
            units[:, : len(kinds)] += emits[key]
            state[:, : len(kinds)] = to[key]
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return state[:, back], units[:, back]

    def place(self, buf: np.ndarray, start: np.ndarray, stop: np.ndarray, entry: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """In each chunk, read from its entry state, the byte position of the unit that so many units of it come before; stop where it has no more."""
        order = np.argsort(start - stop, kind="stable")
        begin, state, skip = start[order], entry[order].astype(np.int64), skip[order]
        found, units, open_ = stop[order].copy(), np.zeros(len(start), np.int64), np.ones(len(start), bool)
        for k, kinds in self.steps(buf, begin, stop[order]):
            m = len(kinds)
            begun = self.emits[state[:m], kinds]
            here = np.flatnonzero(open_[:m] & (begun == 1) & (units[:m] == skip[:m]))
            found[here] = begin[here] + k
            open_[here] = False
            units[:m] += begun
            state[:m] = self.next[state[:m], kinds]
        out = np.empty_like(found)
        out[order] = found
        return out


@cache
def automaton(unit: str, marks: tuple[str, ...]) -> Automaton:
    return Automaton(unit, marks)


def composed(state: np.ndarray, units: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Functions and counts of all chunks from the head of their run through themselves; head: the place of each chunk's run's first. By doubling."""
    state, units = state.copy(), units.copy()
    place, k = np.arange(len(head)), 1
    while True:
        at = place[place - k >= head]
        if not len(at):
            return state, units
        before, sums = state[:, at - k], units[:, at - k]
        units[:, at] = sums + np.take_along_axis(units[:, at], before, axis=0)
        state[:, at] = np.take_along_axis(state[:, at], before, axis=0)
        k *= 2


def scan(buf: np.ndarray, offsets: np.ndarray, machine: Automaton, entry: np.ndarray | None = None, chunk: int = CHUNK):
    """Of each text: functions and counts of the whole (states x texts), and select(text, units), byte positions in the texts of the units that so many units come before; entry: the texts' entry states, 0 where there are none."""
    size = np.diff(offsets)
    n = np.maximum(1, -(-size // chunk))
    owner = np.repeat(np.arange(len(size)), n)
    head = np.repeat(np.cumsum(n) - n, n)
    start = offsets[owner] + (np.arange(len(owner)) - head) * chunk
    stop = np.minimum(start + chunk, offsets[owner + 1])
    through, sums = composed(*machine.read(buf, start, stop), head)
    last = np.cumsum(n) - 1
    entry = np.zeros(len(size), np.int64) if entry is None else entry

    def select(text: np.ndarray, units: np.ndarray) -> np.ndarray:
        total = sums[entry[owner], np.arange(len(owner))]  # units from the text's start through each chunk
        room = int(total.max(initial=0)) + 1
        at = np.searchsorted(total + owner * room, units + text * room, side="right")
        at = np.minimum(at, last[text])
        first = at == head[at]
        before = np.where(first, 0, total[np.maximum(at - 1, 0)])
        state = np.where(first, entry[text], through[entry[text], np.maximum(at - 1, 0)])
        return machine.place(buf, start[at], stop[at], state, units - before) - offsets[text]

    return through[:, last], sums[:, last], select


def draws(id_col: Column, seed: int) -> Column:
    """Four numbers that follow from an id: the first 8-digit groups of the sha256 of seed:id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])


def _whole(text_col: str, unit: str, marks: tuple[str, ...], chunk: int):
    """n, whether a mark occurs and the byte positions of both cuts of each row's text; a text beyond PIECE bytes has been taken out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(unit, marks)
        for batch in batches:
            row = batch.column("row")
            buf, offsets = utf8(pc.struct_field(row, text_col))
            h = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("h1", "h2")]
            out = [[], [], [], []]
            for i, j in blocks(offsets, WORK):
                part = offsets[i : j + 1] - offsets[i]
                state, units, select = scan(buf[offsets[i] : offsets[j]], part, machine, chunk=chunk)
                n, text = units[0], np.arange(j - i)
                cuts = [x[i:j] % (n + 1) for x in h]
                out[0].append(n)
                out[1].append(machine.found[state[0]])
                out[2].append(select(text, np.minimum(*cuts)))
                out[3].append(select(text, np.maximum(*cuts)))
            cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
            yield pa.RecordBatch.from_arrays([row, batch.column("h"), pa.array(cols[0]), pa.array(cols[1].astype(bool)), pa.array(cols[2]), pa.array(cols[3])], ["row", "h", *CUT.names])

    return run


def _piece_sums(unit: str, marks: tuple[str, ...], chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(unit, marks)
        for batch in batches:
            buf, offsets = utf8(batch.column("bytes"))
            state, units, _ = scan(buf, offsets, machine, chunk=chunk)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("k"), pa.array(state.T.tolist(), pa.list_(pa.int64())), pa.array(units.T.tolist(), pa.list_(pa.int64()))], ["key", "k", "to", "units"])

    return run


def _piece_cuts(unit: str, marks: tuple[str, ...], chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(unit, marks)
        for batch in batches:
            buf, offsets = utf8(batch.column("bytes"))
            entry, skip = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("entry", "skip"))
            _, _, select = scan(buf, offsets, machine, entry, chunk)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("which"), pa.array(select(np.arange(len(entry)), skip) + batch.column("from").to_numpy(zero_copy_only=False))], ["key", "which", "at"])

    return run


def giant_cuts(rows: DataFrame, unit: str, marks: tuple[str, ...], piece: int, chunk: int) -> DataFrame:
    """key (of an id and a text), n, marked, left and right for rows: key, h and bytes; the pieces of a text are read in different tasks."""
    machine = automaton(unit, marks)
    one = rows.dropDuplicates(["key"])
    size = F.octet_length("bytes")
    pieces = one.select("key", "bytes", F.explode(F.sequence(F.lit(0), F.floor((size - 1) / piece).cast("int"))).alias("k"))
    pieces = pieces.select("key", "k", F.substring("bytes", F.col("k") * piece + 1, F.lit(piece)).alias("bytes")).repartition("key", "k")
    sums = pieces.mapInArrow(released(_piece_sums(unit, marks, chunk)), "key string, k int, to array<long>, units array<long>")
    # the fold over a text's pieces, in order: entry state and units before each of them
    step = lambda a, x: F.struct(F.get(x["to"], a["state"].cast("int")).alias("state"), (a["n"] + F.get(x["units"], a["state"].cast("int"))).alias("n"), F.array_append(a["seen"], F.struct(x["k"].alias("k"), a["state"].alias("entry"), a["n"].alias("before"))).alias("seen"))
    seen = F.array().cast("array<struct<k:int,entry:bigint,before:bigint>>")
    start = F.struct(F.lit(0).cast("long").alias("state"), F.lit(0).cast("long").alias("n"), seen.alias("seen"))
    folded = sums.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("k", "to", "units"))).alias("all")).select("key", F.aggregate("all", start, step).alias("f"))
    found = F.array(*[F.lit(bool(x)) for x in machine.found])
    cut = lambda i: F.pmod(F.get("h", F.lit(i)), F.col("f.n") + 1)
    texts = folded.join(one.select("key", "h"), "key").select("key", F.col("f.n").alias("n"), F.get(found, F.col("f.state").cast("int")).alias("marked"), F.least(cut(0), cut(1)).alias("left"), F.greatest(cut(0), cut(1)).alias("right"), "f.seen")
    # the last piece that starts at or before the cut's unit
    wanted = texts.select("key", "seen", F.posexplode(F.array("left", "right")).alias("which", "units"))
    wanted = wanted.select("key", "which", "units", F.element_at(F.filter("seen", lambda x: x["before"] <= F.col("units")), -1).alias("x"))
    wanted = wanted.select("key", F.col("x.k").alias("k"), "which", F.col("x.entry").alias("entry"), (F.col("units") - F.col("x.before")).alias("skip"), (F.col("x.k").cast("long") * piece).alias("from"))
    placed = pieces.join(wanted, ["key", "k"]).select("key", "which", "entry", "skip", "from", "bytes").mapInArrow(released(_piece_cuts(unit, marks, chunk)), "key string, which int, at long")
    placed = placed.groupBy("key").agg(F.max(F.when(F.col("which") == 0, F.col("at"))).alias("left"), F.max(F.when(F.col("which") == 1, F.col("at"))).alias("right"))
    return texts.select("key", "n", "marked").join(placed, "key")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char", seed: int = 1, plain_share: int = 10, spm_share: int = 20, marks: tuple[str, str, str] = MARKS, piece: int = PIECE, chunk: int = CHUNK) -> DataFrame:
    """All columns of docs and n (units of the text), form (plain, psm or spm), prefix_chars, middle_chars (units; null if plain) and output.

    The cuts and the form of a row follow from seed and its id. Of a hundred
    texts plain_share stay plain, and so do empty ones and those that hold a
    mark; of the others spm_share in a hundred have the suffix first. unit char
    cuts between code points; word cuts before words ([^\\x20\\x09-\\x0D]+), and
    white space stays with the word before it.
    """
    rows = rowed(docs, h=draws(field(id_col), seed))
    text = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    few = F.octet_length(text) > piece
    split = rows.select("row", "h", F.get("h", F.lit(0)).alias("h1"), F.get("h", F.lit(1)).alias("h2"))
    small = split.where(~few).mapInArrow(released(_whole(text_col, unit, marks, chunk)), T.StructType([rows.schema["row"], rows.schema["h"], *CUT.fields]))
    key = F.concat_ws(":", F.coalesce(F.col("row").getField(id_col).cast("string"), F.lit("")), F.sha2(text, 256))
    giants = rows.where(few).withColumn("key", key)
    cuts = giant_cuts(giants.select("key", "h", F.encode(text, "utf-8").alias("bytes")), unit, marks, piece, chunk)
    large = giants.join(cuts, "key").select("row", "h", *CUT.names)
    h = lambda i: F.get("h", F.lit(i))
    plain = (text == "") | F.col("marked") | (F.pmod(h(2), F.lit(100)) >= 100 - plain_share)
    form = F.when(plain, "plain").when(F.pmod(h(3), F.lit(100)) < spm_share, "spm").otherwise("psm")
    out = small.unionByName(large).withColumns({"form": form, "__raw": F.encode(text, "utf-8")})
    size = F.octet_length("__raw").cast("long")
    part = lambda a, b: F.decode(F.substring("__raw", (a + 1).cast("int"), (b - a).cast("int")), "utf-8")
    prefix, middle, suffix = part(F.lit(0), F.col("left")), part(F.col("left"), F.col("right")), part(F.col("right"), size)
    p, s, m = (F.lit(x) for x in marks)
    output = F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    cut = [F.when(F.col("form") != "plain", F.pmod(h(i), F.col("n") + 1)) for i in (0, 1)]
    out = out.withColumns({"prefix_chars": F.least(*cut), "middle_chars": F.greatest(*cut) - F.least(*cut), "output": output})
    return unrowed(out, docs.columns, ["n", "form", "prefix_chars", "middle_chars", "output"])


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that a form was made of."""
    first = F.when(form == "psm", marks[1]).otherwise(marks[0])
    body = F.substring(output, F.length(F.when(form == "psm", marks[0]).otherwise(marks[1])) + 1, F.length(output))
    # the mark is found by its bytes; no part holds one, and none can arise where parts and marks meet
    head = F.when(form == "psm", F.substring_index(body, marks[1], 1)).otherwise(F.substring_index(body, marks[0], 1))
    rest = F.substring(body, F.length(head) + F.length(first) + 1, F.length(body))
    second = F.substring_index(rest, marks[2], 1)
    third = F.substring(rest, F.length(second) + len(marks[2]) + 1, F.length(rest))
    return F.when(form == "plain", output).when(form == "psm", F.concat(head, third, second)).otherwise(F.concat(second, third, head))
