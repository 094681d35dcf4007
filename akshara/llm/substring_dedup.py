"""Exact removal of repeated word windows by super-k-mer partitioning.

A window is `width` consecutive words of one document. Its minimiser is the
smallest hash of its `seed`-word substrings, so equal windows have equal
minimisers. Consecutive windows that share a minimiser travel together as one
packed string to the bucket of the minimiser: about three times the text moves
instead of `width` times. Each map task first merges equal strings and keeps
the earliest occurrence (the others are known to repeat), so that a text with
any number of copies sends one string per task. In its bucket every window is
sorted with its equals, compared byte for byte and counted exactly.

A seed that many documents hold (found in a bounded sample of documents, which
decides the plan and not the result) ranks behind all others, so that a common
phrase is the minimiser only of windows that hold nothing else: those lie in
common passages, whose equal strings a map task has merged.

Nulls and empty texts have no words; rows with fewer words than `width` keep
all. Rows with equal ids count as one document when order is decided, so that
repeats at equal positions in equal rows both stay. A null id sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from akshara.llm._bytes import blocks, merged, mix, pack, parts, prefix_hash, released, sliding_min, span_hash, unpack, utf8, words
from akshara.llm._frames import NO_ID, field, partitions, rowed, unrowed
from akshara.llm._hot import HotValues, hot_values

WIDTH, SEED = 20, 3
#: Buckets that a reduce task works through one by one.
PER_TASK = 8
#: Bytes of packed strings that a map task holds before it sends them.
HELD = 64 << 20
SPANS = "doc long, key long, start int, stop int"
BLOB = (np.int64, np.int64, np.int32, np.int32, bytes, np.int64, np.int64, np.int32, np.int32)


def normalised(buf: np.ndarray, start: np.ndarray, end: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with one space after each (none where a row ends with its word), and where each starts and ends there."""
    n = len(buf)
    keep = np.zeros(n + 1, np.int8)
    np.add.at(keep, start, 1)
    np.add.at(keep, end, -1)
    inside = np.cumsum(keep[:n]).astype(bool)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    gap = end[(end < n) & ~edge[end]]
    out = buf.copy()
    out[gap] = 32
    inside[gap] = True
    at = np.zeros(n + 1, np.int64)
    np.cumsum(inside, out=at[1:])
    return out[inside], at[start], at[end]


def seed_hashes(text: np.ndarray, s: np.ndarray, e: np.ndarray, seed: int) -> np.ndarray:
    """63 bits of the hash of each seed of normalised bytes, whose words start at s and end at e."""
    return span_hash(prefix_hash(text), s[: len(s) - seed + 1], e[seed - 1 :]) >> np.uint64(1)


def seeds_of(seed: int):
    """The seeds' hashes of one text."""

    def values(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        start, end, _ = words(buf, offsets)
        return seed_hashes(*normalised(buf, start, end, offsets), seed) if len(start) >= seed else np.zeros(0, np.uint64)

    return values


def super_kmers(buf: np.ndarray, offsets: np.ndarray, width: int, seed: int, hot: HotValues | None = None):
    """Runs of windows that share a minimiser: (row, first word in the row, bytes start, bytes end, minimiser) and the normalised bytes; hot seeds rank last."""
    start, end, first = words(buf, offsets)
    text, s, e = normalised(buf, start, end, offsets)
    n = len(s) - width + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none, none.astype(np.uint64), text
    grams = seed_hashes(text, s, e, seed)
    if hot is not None:
        grams[hot.places(grams)] |= np.uint64(1 << 63)
    low = sliding_min(grams, width - seed + 1)
    row = np.searchsorted(first, np.arange(n), side="right") - 1
    valid = np.arange(n) + width <= first[row + 1]
    new = np.ones(n, bool)
    new[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1]) | ~valid[:-1]
    heads = np.flatnonzero(new & valid)
    stops = np.append(np.flatnonzero((new | ~valid)[1:]) + 1, n)
    tails = stops[np.searchsorted(stops, heads, side="right")]
    return row[heads], heads - first[row[heads]], s[heads], e[tails + width - 2], low[heads], text


def _send(held: dict, ties: list, gone: list, n_buckets: int, per_task: int) -> Iterator[pa.RecordBatch]:
    """One blob for each bucket; what is known to be removed goes along, dealt by its key."""
    strings = [*held, *(s for s, _ in ties)]
    values = [*held.values(), *(v for _, v in ties)]
    docs, keys, pos, low, stop = (np.array(x, np.int64) for x in zip(*values, strict=True)) if values else (np.zeros(0, np.int64),) * 5
    bucket = low % n_buckets
    g = np.array(gone, np.int64).reshape(-1, 4)
    g = g[np.lexsort((g[:, 2], g[:, 1], g[:, 0]))]
    if len(g):
        new = np.ones(len(g), bool)
        new[1:] = (g[1:, 0] != g[:-1, 0]) | (g[1:, 1] != g[:-1, 1])
        a, b, owner = merged(g[:, 2], g[:, 3], np.cumsum(new) - 1)
        who = g[np.flatnonzero(new)][owner]
        g = np.stack([who[:, 0], who[:, 1], a, b], 1)
    g_bucket = (mix(g[:, 1].astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)
    order, g_order = np.argsort(bucket, kind="stable"), np.argsort(g_bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    g_cut = np.searchsorted(g_bucket[g_order], np.arange(n_buckets + 1))
    out: list[tuple[int, bytes]] = []
    for k in range(n_buckets):
        own, g_own = order[cut[k] : cut[k + 1]], g[g_order[g_cut[k] : g_cut[k + 1]]]
        if len(own) or len(g_own):
            packed = [strings[i] for i in own]
            out.append((k, pack(docs[own], keys[own], pos[own].astype(np.int32), np.fromiter(map(len, packed), np.int32, len(packed)), b"".join(packed), g_own[:, 0], g_own[:, 1], g_own[:, 2].astype(np.int32), g_own[:, 3].astype(np.int32))))
    for i in range(0, len(out), 64):
        part = out[i : i + 64]
        yield pa.RecordBatch.from_arrays([pa.array([k // per_task for k, _ in part], pa.int32()), pa.array([k for k, _ in part], pa.int32()), pa.array([b for _, b in part], pa.binary())], ["part", "bucket", "blob"])


def _map(width: int, seed: int, n_buckets: int, per_task: int, hot=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple] = {}
        ties: list[tuple] = []
        gone: list[tuple] = []
        size = 0
        common = HotValues(hot.value) if hot is not None else None
        for batch in batches:
            ids, keys = pc.fill_null(batch.column("doc"), NO_ID).to_numpy(), batch.column("key").to_numpy()
            buf, offsets = utf8(batch.column("text"))
            for i, j in blocks(offsets):
                part = offsets[i : j + 1] - offsets[i]
                row, pos, a, b, low, text = super_kmers(buf[offsets[i] : offsets[j]], part, width, seed, common)
                raw = text.tobytes()
                docs, own = ids[i:j][row].tolist(), keys[i:j][row].tolist()
                count = _count_words(text, a, b)
                small = (mix(low) >> np.uint64(2)).astype(np.int64).tolist()
                for d, k, p, x, y, v, n in zip(docs, own, pos.tolist(), a.tolist(), b.tolist(), small, count.tolist(), strict=True):
                    s = raw[x:y]
                    old = held.get(s)
                    if old is None:
                        held[s] = (d, k, p, v, p + n)
                        size += len(s) + 250
                    elif (d, p) < (old[0], old[2]):
                        held[s] = (d, k, p, v, p + n)
                        gone.append((old[0], old[1], old[2], old[4]))
                    elif (d, p) > (old[0], old[2]):
                        gone.append((d, k, p, p + n))
                    elif k != old[1]:  # another row of that id: neither is earlier, so both are judged
                        ties.append((s, (d, k, p, v, p + n)))
                if size > HELD or len(gone) > 2_000_000:
                    yield from _send(held, ties, gone, n_buckets, per_task)
                    held, ties, gone, size = {}, [], [], 0
        yield from _send(held, ties, gone, n_buckets, per_task)

    return run


def _count_words(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words of each slice of normalised bytes: one more than its spaces."""
    spaces = np.zeros(len(text) + 1, np.int64)
    np.cumsum(text == 32, out=spaces[1:])
    return spaces[b] - spaces[a] + 1


def repeated_windows(docs: np.ndarray, keys: np.ndarray, pos: np.ndarray, sizes: np.ndarray, raw: bytes, width: int):
    """(doc, key, start, stop) of the windows in a bucket's strings that also start earlier."""
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    buf = np.frombuffer(raw, np.uint8)
    found = []
    for lo, hi in blocks(offsets):
        s, e, first = words(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        i = np.arange(max(0, len(s) - width + 1))
        own = np.searchsorted(first, i, side="right") - 1
        valid = i + width <= first[own + 1] if len(i) else np.zeros(0, bool)
        i, own = i[valid], own[valid]
        h = span_hash(prefix_hash(buf[offsets[lo] : offsets[hi]]), s[i], e[i + width - 1])
        found.append((h, s[i] + offsets[lo], e[i + width - 1] + offsets[lo], (own + lo).astype(np.int32), (i - first[own]).astype(np.int32)))
    none = [np.zeros(0, np.int64)] * 4
    if not found:
        return none
    h, a, b, entry, inner = (np.concatenate([x[k] for x in found]) for k in range(5))
    del found
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    alike = np.zeros(len(h), bool)
    alike[order[1:][same]] = alike[order[:-1][same]] = True
    w = np.flatnonzero(alike)
    doc, at = docs[entry[w]], pos[entry[w]].astype(np.int64) + inner[w]
    order = np.lexsort((at, doc, h[w]))
    w, doc, at = w[order], doc[order], at[order]
    if not len(w):
        return none
    new = np.ones(len(w), bool)
    new[1:] = h[w][1:] != h[w][:-1]
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    x, y, lx, ly = a[w].tolist(), b[w].tolist(), a[w][lead].tolist(), b[w][lead].tolist()
    equal = np.fromiter((raw[p:q] == raw[r:t] for p, q, r, t in zip(x, y, lx, ly, strict=True)), bool, len(w))
    if not equal.all():  # unequal windows of one hash: group these by their bytes
        seen: dict[bytes, int] = {}
        for k in np.flatnonzero(np.isin(lead, lead[~equal])).tolist():
            lead[k] = seen.setdefault(raw[x[k] : y[k]], k)
    late = (doc > doc[lead]) | ((doc == doc[lead]) & (at > at[lead]))
    w, at = w[late], at[late]
    order = np.lexsort((at, entry[w]))
    w, at = w[order], at[order]
    start, stop, owner = merged(at, at + width, entry[w])
    return [docs[owner], keys[owner], start, stop]


def _reduce(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[bytes]] = {}
        for batch in batches:
            for k, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                blobs.setdefault(k, []).append(blob)
        for k in sorted(blobs):
            parts = [unpack(x, *BLOB) for x in blobs.pop(k)]
            docs, keys, pos, sizes, raw, *gone = (b"".join(x) if kind is bytes else np.concatenate(x) for kind, x in zip(BLOB, zip(*parts, strict=True), strict=True))
            del parts
            found = repeated_windows(docs, keys, pos, sizes, raw, width)
            out = [np.concatenate(x) for x in zip(found, gone, strict=True)]
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2].astype(np.int32)), pa.array(out[3].astype(np.int32))], ["doc", "key", "start", "stop"])

    return run


def cover(starts: np.ndarray, stops: np.ndarray, n: int) -> np.ndarray:
    """Which of n places the intervals cover."""
    at = np.zeros(n + 1, np.int32)
    np.add.at(at, starts, 1)
    np.add.at(at, stops, -1)
    return np.cumsum(at[:n]) > 0


def span_lists(column: pa.Array, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of a batch's span lists, moved by each row's base."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = pc.list_flatten(column)
    row = pc.list_parent_indices(column).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts = [x.to_numpy(zero_copy_only=False).astype(np.int64) + base[row] for x in flat.flatten()]
    return parts[0], parts[1]


def _keep(text_col: str, n_text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in parts(batch, pc.struct_field(batch.column("row"), text_col)):
                start, end, first = words(buf, offsets)
                a, b = span_lists(part.column("spans"), first)
                dropped = cover(a, b, len(start))
                text, s, e = normalised(buf, start[~dropped], end[~dropped], offsets)
                raw = text.tobytes()
                kept = np.concatenate([[0], np.cumsum(~dropped)])[first]
                edges = np.append(s, len(raw))
                texts = []
                for i in range(len(part)):
                    p, q = kept[i], kept[i + 1]
                    texts.append(raw[edges[p] : e[q - 1]] if q > p else b"")
                n = np.diff(first)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(n, pa.int64()), pa.array(n - np.diff(kept), pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["row", "n_words", "n_removed", n_text])

    return run


def document_key(docs: DataFrame, id_col: str, text_col: str):
    return F.xxhash64(field(id_col), field(text_col))


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """The word spans [start, stop) of each row that repeated windows cover, by id and key (a hash of id and text)."""
    n = partitions(docs.sparkSession)
    rows = docs.select(field(id_col).cast("long").alias("doc"), document_key(docs, id_col, text_col).alias("key"), field(text_col).alias("text"))
    hot = hot_values(rows, seeds_of(seed), seed)
    packed = rows.mapInArrow(released(_map(width, seed, n * PER_TASK, PER_TASK, hot)), "part int, bucket int, blob binary")
    return packed.repartitionById(n, F.col("part")).mapInArrow(released(_reduce(width)), SPANS)


def _judged(docs: DataFrame, id_col: str, text_col: str, width: int, seed: int) -> DataFrame:
    """The rows of docs as one struct, n_words, n_removed and kept_text."""
    spans = removed_spans(docs, id_col, text_col, width, seed)
    spans = spans.groupBy("doc", "key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    rows = rowed(docs, doc=F.coalesce(field(id_col).cast("long"), F.lit(NO_ID)), key=document_key(docs, id_col, text_col))
    joined = rows.join(spans, ["doc", "key"], "left").select("row", "spans")
    schema = T.StructType([joined.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    return joined.mapInArrow(released(_keep(text_col, "kept_text")), schema)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """All columns of docs and n_words, n_removed and kept_text: the words that no repeated window covers, joined by one space.

    A window is repeated if its word sequence also starts earlier (smaller id,
    or same id and an earlier start); all are judged on the input. A null text
    is kept as an empty one. New columns replace old ones of their names.
    """
    return unrowed(_judged(docs, id_col, text_col, width, seed), docs.columns, ["n_words", "n_removed", "kept_text"])


def repeats_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """docs with the kept words as the text of rows that lose words, and its code points in length_col, where there is one; all else as it was."""
    out = _judged(docs, id_col, text_col, width, seed)
    own = lambda c: F.col("row").getField(c)
    new = {text_col: F.col("kept_text"), length_col: F.char_length("kept_text").cast("long")}
    return out.select(*[(F.when(F.col("n_removed") == 0, own(c)).otherwise(new[c]) if c in new else own(c)).alias(c) for c in docs.columns])
