"""Exact removal of repeated byte strings by a common-prefix-aware distributed merge sort.

Every `width`-byte window has an anchor: its leftmost position of smallest
`gram`-byte hash, which its bytes alone decide. Only the suffixes at anchors
are sorted (a sparse suffix array, about one in 190 positions), each with the
bytes that its windows need: equal windows have anchors at equal offsets, with
equal bytes to the right, so they stand together in suffix order.

A map task merges equal contexts, sorts its suffixes and sends each bucket a
front-coded run: for each suffix the length it shares with the one before, and
the rest. A bucket (the hash of the anchor's gram; what shares a prefix of
`gram` bytes meets in one) merges its runs with a loser tree. The tree keeps for
each loser the prefix it is known to share with the last winner, so it never
compares those bytes again, and gives the sorted order with its
longest-common-prefix array. That array decides the right parts of windows: two
suffixes of common prefix r, whose left parts share the last s bytes, have a
window in common if r + s >= `width`, and then all bytes from s before their
anchors to r after them are repeated. Stretches of the array are joined by
falling prefix, the smaller into the larger, and each suffix that moves is
compared with its neighbours in the order of the reversed left parts; no other
pair can add anything. So a stretch takes memory for its contexts alone, and no
row per window.

Grams that many documents hold (found in a bounded sample of documents, which
decides the plan and not the result) are anchors only of windows that have no
others, so a common line draws no contexts of different texts into one bucket;
windows of common grams alone lie in common passages, and those are equal
contexts, of which a map task sends one.

Null and empty texts and those shorter than `width` keep all. Rows of equal id
and text count as two documents, so each repeats the other.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from akshara.llm._bytes import blocks, merged, mix, pack, parts, prefix_hash, released, sliding_min, span_hash, unpack, utf8
from akshara.llm._frames import NO_ID, field, partitions, rowed, unrowed
from akshara.llm._hot import HotValues, hot_values
from akshara.llm.substring_dedup import SPANS, cover, document_key, span_lists

WIDTH, GRAM = 400, 32
#: Buckets that a reduce task works through one by one.
PER_TASK = 8
#: Bytes of contexts that a map task holds before it sends a run.
HELD = 64 << 20
RUN = (np.int64, np.int64, np.int32, np.int32, np.int8, np.int32, np.int32, bytes, bytes, np.int64, np.int64, np.int32, np.int32)


def shared(x: bytes, y: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which `known` bytes need no comparison."""
    n = min(len(x), len(y))
    a, b = x[known:n], y[known:n]
    if a == b:
        return n
    return n - ((int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length() + 7) // 8


def front_code(suffixes: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Of sorted suffixes: the length shared with the one before, and the rest."""
    lcp, rest, last = np.zeros(len(suffixes), np.int32), [], b""
    for i, s in enumerate(suffixes):
        lcp[i] = k = shared(last, s)
        rest.append(s[k:])
        last = s
    return lcp, rest


def front_decode(lcp: list[int], sizes: list[int], rest: bytes) -> list[bytes]:
    out, last, at = [], b"", 0
    for k, n in zip(lcp, sizes, strict=True):
        last = last[:k] + rest[at : at + n - k]
        at += n - k
        out.append(last)
    return out


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, index, prefix shared with the one before) of all suffixes in order, by a loser tree.

    runs: sorted suffixes and the length that each shares with the one before.
    """
    k = len(runs)
    at, known = [0] * k, [0] * k
    now: list[bytes | None] = [r[0][0] if r[0] else None for r in runs]
    losers = [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's known prefix becomes that with the winner."""
        x, y = now[a], now[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        i, j = known[a], known[b]
        if i > j:
            return a, b
        if j > i:
            return b, a
        h = shared(x, y, i)
        if x[h : h + 1] <= y[h : h + 1]:
            known[b] = h
            return a, b
        known[a] = h
        return b, a

    winners = [-1] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    w = winners[1] if k > 1 else 0
    while k and now[w] is not None:
        yield w, at[w], known[w]
        at[w] += 1
        suffixes, lcp = runs[w]
        if at[w] < len(suffixes):
            now[w], known[w] = suffixes[at[w]], lcp[at[w]]
        else:
            now[w] = None
        node = (w + k) >> 1
        while node:
            w, losers[node] = play(w, losers[node])
            node >>= 1


def gram_hashes(buf: np.ndarray, gram: int) -> np.ndarray:
    """31 bits of the hash of the gram at each place."""
    at = np.arange(max(0, len(buf) - gram + 1))
    return span_hash(prefix_hash(buf), at, at + gram) >> np.uint64(33)


def contexts(buf: np.ndarray, offsets: np.ndarray, width: int, gram: int, hot: HotValues | None = None):
    """Of each anchor: row, first window, end of the last window, anchor (byte places) and gram hash; hot grams rank last."""
    n = len(buf) - width + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none, none
    grams = gram_hashes(buf, gram)
    if hot is not None:
        grams[hot.places(grams)] |= np.uint64(1 << 31)
    grams = grams << np.uint64(32) | np.arange(len(grams), dtype=np.uint64)
    low = sliding_min(grams, width - gram + 1)
    row = np.searchsorted(offsets, np.arange(n), side="right") - 1
    window = np.flatnonzero(np.arange(n) + width <= offsets[row + 1])
    if not len(window):
        return none, none, none, none, none
    low = low[window]
    heads = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
    lo, hi = window[heads], window[np.append(heads[1:], len(window)) - 1]
    low = low[heads]
    return row[lo], lo, hi + width, (low & np.uint64(0xFFFFFFFF)).astype(np.int64), (low >> np.uint64(32)).astype(np.int64)


def _send(held: dict, gone: list, n_buckets: int, per_task: int) -> Iterator[pa.RecordBatch]:
    """A sorted, front-coded run for each bucket; what is known to be removed goes along, dealt by its key."""
    own: list[list] = [[] for _ in range(n_buckets)]
    for s, v in held.items():
        own[v[4] % n_buckets].append((s, v))
    g = np.array(gone, np.int64).reshape(-1, 4)
    g = g[np.lexsort((g[:, 2], g[:, 1], g[:, 0]))]
    if len(g):
        new = np.append(True, (g[1:, 0] != g[:-1, 0]) | (g[1:, 1] != g[:-1, 1]))
        a, b, owner = merged(g[:, 2], g[:, 3], np.cumsum(new) - 1)
        who = g[np.flatnonzero(new)][owner]
        g = np.stack([who[:, 0], who[:, 1], a, b], 1)
    g_bucket = (mix(g[:, 1].astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)
    g_order = np.argsort(g_bucket, kind="stable")
    g_cut = np.searchsorted(g_bucket[g_order], np.arange(n_buckets + 1))
    out: list[tuple[int, bytes]] = []
    for k, entries in enumerate(own):
        g_own = g[g_order[g_cut[k] : g_cut[k + 1]]]
        if entries or len(g_own):
            entries = sorted((s[v[3] :], s[: v[3]], *v[:4], v[5]) for s, v in entries)
            lcp, rest = front_code([x[0] for x in entries])
            docs, keys, lo, off, dup = (np.array([x[i] for x in entries], np.int64) for i in range(2, 7))
            out.append((k, pack(docs, keys, lo.astype(np.int32), off.astype(np.int32), dup.astype(np.int8), lcp, np.fromiter((len(x[0]) for x in entries), np.int32, len(entries)), b"".join(rest), b"".join(x[1] for x in entries), g_own[:, 0], g_own[:, 1], g_own[:, 2].astype(np.int32), g_own[:, 3].astype(np.int32))))
        own[k] = entries = []
        if len(out) == 64:
            yield _blobs(out, per_task)
            out = []
    if out:
        yield _blobs(out, per_task)


def _blobs(out: list[tuple[int, bytes]], per_task: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k // per_task for k, _ in out], pa.int32()), pa.array([k for k, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], ["part", "bucket", "blob"])


def _map(width: int, gram: int, n_buckets: int, per_task: int, hot=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple] = {}
        gone: list[tuple] = []
        size = 0
        common = HotValues(hot.value) if hot is not None else None
        for batch in batches:
            ids, keys = pc.fill_null(batch.column("doc"), NO_ID).to_numpy(), batch.column("key").to_numpy()
            buf, offsets = utf8(batch.column("text"))
            for i, j in blocks(offsets):
                raw = buf[offsets[i] : offsets[j]].tobytes()
                part = offsets[i : j + 1] - offsets[i]
                row, lo, end, anchor, h = contexts(buf[offsets[i] : offsets[j]], part, width, gram, common)
                docs, own = ids[i:j][row].tolist(), keys[i:j][row].tolist()
                for d, k, a, b, p, v, base in zip(docs, own, lo.tolist(), end.tolist(), anchor.tolist(), h.tolist(), part[row].tolist(), strict=True):
                    s = raw[a:b]
                    old = held.get(s)
                    if old is None:
                        held[s] = (d, k, a - base, p - a, v, 0)
                        size += len(s) + 300
                    else:
                        gone.append((d, k, a - base, b - base))
                        if not old[5]:
                            held[s] = (*old[:5], 1)
                if size > HELD or len(gone) > 1_000_000:
                    yield from _send(held, gone, n_buckets, per_task)
                    held, gone, size = {}, [], 0
        yield from _send(held, gone, n_buckets, per_task)

    return run


def reaches(lefts: list[bytes], lcp: list[int], width: int) -> tuple[list[int], list[int]]:
    """Bytes before and after each anchor of a stretch that repeated windows cover.

    lefts: the reversed left parts in suffix order; lcp: the prefix that each
    suffix shares with the one before.
    """
    n = len(lefts)
    before, after = [0] * n, [0] * n

    def meet(i: int, j: int, r: int) -> None:
        x, y = lefts[i], lefts[j]
        if min(len(x), len(y)) + r < width:
            return
        s = shared(x, y)
        if s + r >= width:
            for k in (i, j):
                before[k], after[k] = max(before[k], s), max(after[k], r)

    if n == 2:
        meet(0, 1, lcp[1])
        return before, after
    home = list(range(n))
    sets: list[list | None] = [[(x, i)] for i, x in enumerate(lefts)]

    def root(i: int) -> int:
        while home[i] != i:
            home[i] = i = home[home[i]]
        return i

    for k in sorted(range(1, n), key=lambda k: -lcp[k]):
        r, a, b = lcp[k], root(k - 1), root(k)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        large = sets[a]
        for entry in sets[b]:
            at = bisect_left(large, entry)
            if at:
                meet(entry[1], large[at - 1][1], r)
            if at < len(large):
                meet(entry[1], large[at][1], r)
            large.insert(at, entry)
        sets[b], home[b] = None, a
    return before, after


def _reduce(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[bytes]] = {}
        for batch in batches:
            for k, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                blobs.setdefault(k, []).append(blob)
        for k in sorted(blobs):
            pieces = [unpack(x, *RUN) for x in blobs.pop(k)]
            out = [[np.concatenate([p[c] for p in pieces])] for c in range(9, 13)]
            runs, lefts = [], []
            for p in pieces:
                lcp = p[5].tolist()
                runs.append((front_decode(lcp, p[6].tolist(), p[7]), lcp))
                cut = np.concatenate([[0], np.cumsum(p[3], dtype=np.int64)]).tolist()
                lefts.append([p[8][cut[i] : cut[i + 1]] for i in range(len(lcp))])
            group: list[tuple[int, int]] = []
            lcp: list[int] = []
            spans: list[tuple[int, int, int, int]] = []

            def settle():
                if len(group) > 1:
                    before, after = reaches([lefts[r][i][::-1] for r, i in group], lcp, width)
                else:
                    before, after = [0], [0]
                for (r, i), s, e in zip(group, before, after, strict=True):
                    p = pieces[r]
                    if p[4][i]:  # the whole context occurs twice
                        spans.append((p[0][i], p[1][i], p[2][i], p[2][i] + p[3][i] + p[6][i]))
                    elif e:
                        anchor = p[2][i] + p[3][i]
                        spans.append((p[0][i], p[1][i], anchor - s, anchor + e))

            for r, i, same in merge_runs(runs):
                if same < gram:
                    if len(group) > 1 or group and pieces[group[0][0]][4][group[0][1]]:
                        settle()
                    group.clear()
                    lcp.clear()
                group.append((r, i))
                lcp.append(same)
            if group:
                settle()
            found = np.array(spans, np.int64).reshape(-1, 4)
            for o, x in zip(out, found.T, strict=True):
                o.append(x)
            cols = [np.concatenate(x) for x in out]
            if len(cols[0]):
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2].astype(np.int32)), pa.array(cols[3].astype(np.int32))], ["doc", "key", "start", "stop"])

    return run


def _keep(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in parts(batch, pc.struct_field(batch.column("row"), text_col)):
                a, b = span_lists(part.column("spans"), offsets[:-1])
                gone = cover(a, b, len(buf))
                edge = np.zeros(len(buf) + 1, bool)
                edge[offsets] = True
                opens = gone & (np.append(True, ~gone[:-1]) if len(gone) else gone)
                opens |= gone & edge[:-1]
                total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[offsets])
                kept = buf[~gone]
                at = np.concatenate([[0], np.cumsum(total(~gone))]).astype(np.int32)
                texts = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(kept.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(np.diff(offsets)), pa.array(total(gone)), pa.array(total(opens)), texts], ["row", "n_bytes", "n_removed", "n_spans", "kept_bytes"])

    return run


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """The byte spans [start, stop) of each row that repeated strings cover, by id and key (a hash of id and text)."""
    n = partitions(docs.sparkSession)
    rows = docs.select(field(id_col).cast("long").alias("doc"), document_key(docs, id_col, text_col).alias("key"), field(text_col).alias("text"))
    hot = hot_values(rows, lambda buf, offsets: gram_hashes(buf, gram), gram)
    sent = rows.mapInArrow(released(_map(width, gram, n * PER_TASK, PER_TASK, hot)), "part int, bucket int, blob binary")
    return sent.repartitionById(n, F.col("part")).mapInArrow(released(_reduce(width, gram)), SPANS)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """All columns of docs and n_bytes, n_removed, n_spans and kept_bytes: the UTF-8 bytes that no repeated string covers.

    A string of `width` bytes is repeated if it also starts anywhere else, in
    the same row or another; overlaps count, and all are judged on the input.
    A null text counts as empty. New columns replace old ones of their names.
    """
    spans = removed_spans(docs, id_col, text_col, width, gram)
    spans = spans.groupBy("doc", "key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    rows = rowed(docs, doc=F.coalesce(field(id_col).cast("long"), F.lit(NO_ID)), key=document_key(docs, id_col, text_col))
    joined = rows.join(spans, ["doc", "key"], "left").select("row", "spans")
    new = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    schema = T.StructType([joined.schema["row"], *new, T.StructField("kept_bytes", T.BinaryType())])
    return unrowed(joined.mapInArrow(released(_keep(text_col)), schema), docs.columns, ["n_bytes", "n_removed", "n_spans", "kept_bytes"])
