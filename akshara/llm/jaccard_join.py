"""Exact Jaccard join of word-shingle sets in the metric space 1 - similarity.

1. Documents of equal sets form a class (128-bit sums of shingle hashes). A
   class can be within distance t of another only if others hold 1 - t of its
   shingles; one exchange of packed hash fragments counts that for every class,
   and classes too far from all others are done.
2. The rest is cut into regions that no link leaves: the first t n + 1 shingles
   of a class, the rarest among these classes first, act as pivots (a single
   shingle is a point of the space too, nearest to the sets that hold it); two
   classes within t share one. Classes that share pivots, directly or through
   others, form a region.
3. A region of more classes or bytes than a task takes is divided across the
   cluster. In each round some of its classes, drawn from outside its largest
   known component, are pivots: broadcast (their number is bounded), and measured
   against every class of the region where that lies. Their links are then all
   known, so they leave. The first of them make Voronoi cells: a class goes to the
   cell of its nearest pivot and to every cell whose pivot is no more than 2 t
   farther, which by the triangle inequality covers all its links. If that does
   not make the cells smaller (near copies of one text are near every pivot), the
   region stays one and the links found are its progress: a cell whose classes
   are all connected is done.
4. A cell that fits is joined by one task in the same way, in memory: Voronoi cells
   recurse; one that no longer shrinks is finished pivot by pivot: classes
   outside the largest component, one after another, against those that the
   windows |d(x, p) - d(y, p)| <= t leave.

All tests of links are exact integer comparisons of set sizes. Sets hold 64-bit
hashes of shingles. A null, empty or blank text has an empty set and no links;
with fewer words than a shingle the whole sequence is one shingle. Rows of equal
id are documents of their own with that id; a null id sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from akshara.llm._bytes import blocks, mix, pack, prefix_hash, released, span_hash, trimmed, unpack, utf8, words
from akshara.llm._frames import NO_ID, checkpointed, field, partitions, rowed, unrowed
from akshara.llm.components import connected_components
from akshara.llm.substring_dedup import document_key, normalised

SHINGLE, PERCENT = 5, 80
PER_TASK = 2
#: Classes and bytes of text that a task joins in memory.
CELL, CELL_BYTES = 256, 32 << 20
#: Larger cells that are divided in one round, pivots of each, and shingles of all these pivots.
AT_ONCE, QUERIES, QUERY_SHINGLES = 64, 4096, 3_000_000
#: Shared shingles that are counted at a time.
MATCHES = 2_000_000
#: Shingles that a map task holds before it sends them.
HELD = 3_000_000
#: Cells of no more classes are compared directly; pivots of a cell.
SMALL, PIVOTS = 64, 12
FACTS = "kind int, doc long, key long, n long, fa long, fb long"
#: Bytes of a shingle from which it is hashed by itself.
LONG = 256
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows in one array, and the rows' offsets in it."""
    buf = LOWER[buf]
    start, end, first = words(buf, offsets)
    text, s, e = normalised(buf, start, end, offsets)
    prefix = prefix_hash(text)
    n = np.diff(first)
    count = np.where(n == 0, 0, np.maximum(n - shingle + 1, 1))
    row = np.repeat(np.arange(len(n)), count)
    i = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
    begin, stop = s[i], e[np.minimum(i + shingle, first[row + 1]) - 1]
    h = span_hash(prefix, begin, stop)
    # a polynomial modulo 2^64 has known collisions from about a thousand bytes on
    for k in np.flatnonzero(stop - begin > LONG).tolist():
        h[k] = int.from_bytes(blake2b(text[begin[k] : stop[k]].tobytes(), digest_size=8).digest())
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(n) + 1))


def set_names(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit names of the rows' sets."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(salt)), dtype=np.uint64)])
        out.append(mix(total[at[1:]] - total[at[:-1]] + np.uint64(salt)).view(np.int64))
    return out[0], out[1]


def code(h: np.ndarray, n_buckets: int, bits: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and remainder of a hash, for counting. Remainders that collide between sets keep more candidates; for those within a set see lost()."""
    return (h >> np.uint64(40)) % np.uint64(n_buckets), (h & np.uint64((1 << bits) - 1)).astype(np.uint32)


def lost(h: np.ndarray, at: np.ndarray, bits: int = 32) -> np.ndarray:
    """How many shingles of each row's set may count as one with another of that set: those of equal remainders."""
    n = len(at) - 1
    row = np.repeat(np.arange(n, dtype=np.uint64), np.diff(at))
    both = np.sort(row << np.uint64(32) | h & np.uint64((1 << bits) - 1))
    return np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(32)).astype(np.int64), minlength=n)


def short(fa: np.ndarray) -> np.ndarray:
    """40 bits of a set's name, for counting; classes of equal short names are all kept as candidates."""
    return fa.view(np.uint64) >> np.uint64(24)


def _blobs(bucket: np.ndarray, n_buckets: int, per_task: int, fragment) -> Iterator[pa.RecordBatch]:
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    out = [(k, fragment(k, order[cut[k] : cut[k + 1]])) for k in range(n_buckets)]
    for i in range(0, len(out), 256):
        part = [(k, b) for k, b in out[i : i + 256] if b is not None]
        yield pa.RecordBatch.from_arrays([pa.array([k // per_task for k, _ in part], pa.int32()), pa.array([k for k, _ in part], pa.int32()), pa.array([b for _, b in part], pa.binary())], ["part", "bucket", "blob"])


def _map_counts(shingle: int, n_buckets: int, per_task: int, bits: int):
    def send(held: list) -> Iterator[pa.RecordBatch]:
        docs, keys, n, fa, fb, less = (np.concatenate([x[i] for x in held]) for i in range(6))
        h = np.concatenate([x[6] for x in held])
        held.clear()
        _, lead = np.unique(np.stack([fa, fb], 1), axis=0, return_index=True)  # equal sets send their shingles once
        first = np.zeros(len(n), bool)
        first[lead] = True
        h = h[np.repeat(first, n)]
        owner = np.repeat(np.flatnonzero(first).astype(np.int32), n[first])
        bucket, rest = code(h, n_buckets, bits)
        bucket = bucket.astype(np.int32)
        del h
        own_bucket = mix(keys.view(np.uint64)) % np.uint64(n_buckets)
        own_order = np.argsort(own_bucket, kind="stable")
        own_cut = np.searchsorted(own_bucket[own_order], np.arange(n_buckets + 1))

        def fragment(k: int, of: np.ndarray) -> bytes:
            row = own_order[own_cut[k] : own_cut[k + 1]]
            who, local = np.unique(owner[of], return_inverse=True)
            name = short(fa[who])
            return pack(rest[of], np.diff(local, prepend=0).astype(np.uint8), name.astype(np.uint32), (name >> np.uint64(32)).astype(np.uint8), docs[row], keys[row], n[row], fa[row], fb[row], less[row])

        yield from _blobs(bucket, n_buckets, per_task, fragment)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids, keys = pc.fill_null(batch.column("doc"), NO_ID).to_numpy(), batch.column("key").to_numpy()
            buf, offsets = utf8(batch.column("text"))
            for i, j in blocks(offsets):
                h, at = shingle_sets(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle)
                fa, fb = set_names(h, at)
                held.append((ids[i:j], keys[i:j], np.diff(at), fa, fb, lost(h, at, bits), h))
                size += len(h)
                if size > HELD:
                    yield from send(held)
                    held, size = [], 0
        if held:
            yield from send(held)

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    blobs: dict[int, list[bytes]] = {}
    for batch in batches:
        for k, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            blobs.setdefault(k, []).append(blob)
    for k in sorted(blobs):
        yield k, blobs.pop(k)


def _facts(kind: int, *cols) -> pa.RecordBatch:
    n = max(len(c) for c in cols if c is not None)
    arrays = [pa.nulls(n, pa.int64()) if c is None else pa.array(np.ascontiguousarray(c).astype(np.int64)) for c in cols]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *arrays], ["kind", "doc", "key", "n", "fa", "fb"])


def _reduce_counts():
    kinds = (np.uint32, np.uint8, np.uint32, np.uint8, *[np.int64] * 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, blobs in _gathered(batches):
            parts = [unpack(b, *kinds) for b in blobs]
            *own, less = (np.concatenate([p[i] for p in parts]) for i in range(4, 10))
            if len(own[0]):
                yield _facts(0, *own)
            if less.any():  # count as shared, so that no class is closed for them
                yield _facts(1, None, None, less[less > 0], short(own[3][less > 0]).astype(np.int64), None)
            h = np.concatenate([p[0] for p in parts])
            if not len(h):
                continue
            base = np.cumsum([0] + [len(p[2]) for p in parts[:-1]])
            who = np.concatenate([np.cumsum(p[1], dtype=np.int64) + b for p, b in zip(parts, base, strict=True)])
            name, number = np.unique(np.concatenate([p[2] | p[3].astype(np.uint64) << np.uint64(32) for p in parts]), return_inverse=True)
            pair = np.unique(h.astype(np.uint64) << np.uint64(32) | number[who].astype(np.uint64))
            h, who = pair >> np.uint64(32), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
            heads = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            count = np.diff(np.append(heads, len(h)))
            repeated = np.bincount(who[np.repeat(count, count) > 1], minlength=len(name))
            has = np.flatnonzero(repeated)
            if len(has):
                yield _facts(1, None, None, repeated[has], name[has], None)

    return run


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of an array with equal values side by side: the values, and for each place 1 where a new one begins (0 at the first), and where."""
    new = np.append(False, x[1:] != x[:-1]) if len(x) else np.zeros(0, bool)
    heads = np.flatnonzero(np.append(True, new[1:])) if len(x) else np.zeros(0, np.int64)
    return x[heads], new.astype(np.uint8), heads


def _map_shingles(shingle: int, n_buckets: int, per_task: int):
    """All shingles of the classes, to the buckets of their hashes."""

    def send(held: list) -> Iterator[pa.RecordBatch]:
        h, name, n = (np.concatenate([x[i] for x in held]) for i in range(3))
        held.clear()

        def fragment(k: int, of: np.ndarray):
            names, steps, heads = _runs(name[of])
            return pack(h[of], steps, names, n[of][heads]) if len(of) else None

        yield from _blobs((h >> np.uint64(40)) % np.uint64(n_buckets), n_buckets, per_task, fragment)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            names = batch.column("fa").to_numpy()
            buf, offsets = utf8(batch.column("text"))
            for i, j in blocks(offsets):
                h, at = shingle_sets(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle)
                n = np.diff(at)
                held.append((h, np.repeat(names[i:j], n), np.repeat(n, n)))
                size += len(h)
                if size > HELD:
                    yield from send(held)
                    size = 0
        if held:
            yield from send(held)

    return run


def _reduce_holders(n_buckets: int, per_task: int):
    """Each shingle that several classes hold, with their number, back to the buckets of the classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in _gathered(batches):
            parts = [unpack(b, np.uint64, np.uint8, np.int64, np.int64) for b in blobs]
            h = np.concatenate([p[0] for p in parts])
            base = np.cumsum([0] + [len(p[2]) for p in parts[:-1]])
            who = np.concatenate([np.cumsum(p[1], dtype=np.int64) + b for p, b in zip(parts, base, strict=True)])
            names, n = (np.concatenate([p[i] for p in parts]) for i in (2, 3))
            order = np.argsort(h, kind="stable")
            heads = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
            count = np.diff(np.append(heads, len(h)))
            holders = np.repeat(count, count)
            order, holders = order[holders > 1], holders[holders > 1].astype(np.uint32)
            back = np.argsort(who[order], kind="stable")
            order, holders = order[back], holders[back]
            name, n, h = names[who[order]], n[who[order]], h[order]

            def fragment(k: int, of: np.ndarray, name=name, n=n, h=h, holders=holders):
                own, steps, heads = _runs(name[of])
                return pack(h[of], steps, own, n[of][heads], holders[of]) if len(of) else None

            yield from _blobs((mix(name.view(np.uint64)) % np.uint64(n_buckets)).astype(np.int64), n_buckets, per_task, fragment)

    return run


def _choose_pivots(percent: int, n_buckets: int, per_task: int):
    """The rarest shingles of each class that are enough to meet every class within reach, to the buckets of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in _gathered(batches):
            parts = [unpack(b, np.uint64, np.uint8, np.int64, np.int64, np.uint32) for b in blobs]
            h, holders = np.concatenate([p[0] for p in parts]), np.concatenate([p[4] for p in parts])
            name, n = (np.concatenate([p[i][np.cumsum(p[1], dtype=np.int64)] for p in parts]) for i in (2, 3))
            order = np.lexsort((h, holders, name))
            h, name, n = h[order], name[order], n[order]
            _, _, heads = _runs(name)
            several = np.repeat(np.diff(np.append(heads, len(name))), np.diff(np.append(heads, len(name))))
            place = np.arange(len(name)) - np.repeat(heads, np.diff(np.append(heads, len(name)))) + n - several  # those that no other holds come first
            keep = place < n - (n * percent + 99) // 100 + 1
            h, name = h[keep], name[keep]
            yield from _blobs((h >> np.uint64(40)) % np.uint64(n_buckets), n_buckets, per_task, lambda k, of, h=h, name=name: pack(h[of], name[of]) if len(of) else None)

    return run


def _reduce_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An edge from the smallest class of each pivot to its others."""
    for _, blobs in _gathered(batches):
        parts = [unpack(b, np.uint64, np.int64) for b in blobs]
        h, node = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.lexsort((node, h))
        h, node = h[order], node[order]
        heads = np.append(True, h[1:] != h[:-1])
        root = node[np.flatnonzero(heads)[np.cumsum(heads) - 1]]
        edge = np.unique(np.stack([root, node], 1)[root != node], axis=0)
        if len(edge):
            yield pa.RecordBatch.from_arrays([pa.array(edge[:, 0]), pa.array(edge[:, 1])], ["a", "b"])


def band(n: np.ndarray, percent: int) -> np.ndarray:
    """Bands of set sizes, so wide that sets within reach of each other are in one or in neighbours."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(100 / percent) * (1 - 1e-9)).astype(np.int64)


def common(h: np.ndarray, size: np.ndarray, index: tuple) -> np.ndarray:
    """How many shingles each set (h holds them one after another) shares with each pivot of an index."""
    of, ph, owner = index
    lo = np.searchsorted(ph, h)
    count = np.searchsorted(ph, h, side="right") - lo
    row = np.repeat(np.arange(len(size)), size)
    total = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(len(size) * len(of), np.int64)
    cuts = np.unique(np.append(np.searchsorted(total, np.arange(0, total[-1], MATCHES)), len(h)))
    for a, b in zip(np.append(0, cuts[:-1]), cuts, strict=True):
        c = count[a:b]
        at = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(lo[a:b], c)
        out += np.bincount(np.repeat(row[a:b], c) * len(of) + owner[at], minlength=len(out))
    return out.reshape(len(size), len(of))


def _measure(pivots, shingle: int, percent: int):
    """Against the pivots of its cell, each class.

    Kind 0: a link (a, b). Kind 1: a class b of cell a goes to that of pivot k
    (home: the nearest) and is linked with pivot c. Kind 2: pivots or labels a
    and b that are connected.
    """
    reach = 2 * (1 - percent / 100) + 1e-9

    def out(kind: int, a, b, c=None, k=None, home=None) -> pa.RecordBatch:
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(n, pa.int64()) if c is None else c, pa.nulls(n, pa.int32()) if k is None else pa.array(k.astype(np.int32)), pa.nulls(n, pa.bool_()) if home is None else pa.array(home)], ["kind", "a", "b", "c", "k", "home"])

    def pairs(kind: int, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.unique(np.stack([a, b], 1)[a != b], axis=0)
        if len(edge):
            yield out(kind, edge[:, 0], edge[:, 1])

    def against(cell: int, fa: np.ndarray, label: np.ndarray, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        names, size, centres, bands = pivots.value[cell]
        n = np.array([len(s) for s in sets], np.int64)
        linked = np.zeros((len(n), len(names)), bool)
        own = band(n, percent)
        # sets within reach of each other differ by one band of sizes at most
        for x in np.unique(own).tolist():
            rows = np.flatnonzero(own == x)
            h, count = np.concatenate([sets[k] for k in rows]), n[rows]
            for index in (bands[k] for k in (x - 1, x, x + 1) if k in bands):
                both = common(h, count, index)
                linked[np.ix_(rows, index[0])] = 100 * both >= percent * (count[:, None] + size[index[0]] - both)
        r, p = np.nonzero(linked)
        first, some = names[np.argmax(linked, axis=1)], linked.any(axis=1)
        yield from pairs(0, np.concatenate([fa[some], names[p]]), np.concatenate([first[some], first[r]]))
        known = some & (label != fa)
        yield from pairs(2, np.concatenate([label[known], names[p]]), np.concatenate([first[known], first[r]]))
        rest = np.flatnonzero(~np.isin(fa, names))
        if len(rest):
            both = common(np.concatenate([sets[k] for k in rest]), n[rest], centres)
            d = 1 - both / (n[rest][:, None] + size[centres[0]] - both)
            r, k = np.nonzero(d <= d.min(axis=1, keepdims=True) + reach)
            yield out(1, np.full(len(r), cell), fa[rest[r]], pa.array(first[rest[r]], pa.int64(), mask=~some[rest[r]]), k, k == d.argmin(axis=1)[r])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, fa, label = (batch.column(c).to_numpy() for c in ("cell", "fa", "label"))
            buf, offsets = utf8(batch.column("text"))
            for i, j in blocks(offsets, 1 << 17):
                h, at = shingle_sets(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle)
                for cell in np.unique(cells[i:j]).tolist():
                    of = np.flatnonzero(cells[i:j] == cell)
                    yield from against(cell, fa[i:j][of], label[i:j][of], [h[at[k] : at[k + 1]] for k in of])

    return run


def _pivots(rows: list, shingle: int, percent: int) -> dict[int, tuple]:
    """Of each cell's pivots: names, set sizes, an index of the first, which make cells, and one for each band of sizes."""
    found: dict[int, list] = {}
    for r in rows:
        raw = np.frombuffer(r.text.encode(), np.uint8)
        found.setdefault(r.cell, []).append((r.fa, shingle_sets(raw, np.array([0, len(raw)]), shingle)[0]))
    out = {}
    for cell, own in found.items():
        size = np.array([len(h) for _, h in own], np.int64)
        h = np.concatenate([h for _, h in own])
        owner = np.repeat(np.arange(len(own)), size)

        def index(of: np.ndarray, h=h, owner=owner):
            """Places of some pivots, and all their shingles in order with which of these holds each."""
            rank = np.full(len(own), -1)
            rank[of] = np.arange(len(of))
            some = rank[owner] >= 0
            order = np.argsort(h[some], kind="stable")
            return of, h[some][order], rank[owner][some][order]

        bands = band(size, percent)
        out[cell] = (np.array([fa for fa, _ in own], np.int64), size, index(np.arange(min(PIVOTS, len(own)))), {k: index(np.flatnonzero(bands == k)) for k in np.unique(bands).tolist()})
    return out


def _divided(members: DataFrame, shingle: int, percent: int, limit: int, queries: int) -> tuple[DataFrame, DataFrame]:
    """The members (cell, fa, n, text) in cells that a task can join, with the label of their known component, and the links found on the way."""
    spark = members.sparkSession
    members = checkpointed(members.withColumn("label", F.col("fa")))
    done, edges = [], [spark.createDataFrame([], "a long, b long")]
    group: dict[int, int] = {}  # of pivots only

    def root(x: int) -> int:
        while group.setdefault(x, x) != x:
            group[x] = x = group[group[x]]
        return x

    turn = 0
    while True:
        per = members.groupBy("cell", "label").agg(F.count("*").alias("m"), F.sum("n").alias("n"), F.sum(F.octet_length("text")).alias("size"))
        cells = per.groupBy("cell").agg(F.sum("m").alias("m"), F.max(F.struct("m", "label")).alias("big"), F.sum("n").alias("n"), F.sum("size").alias("size"))
        cells = cells.where(F.col("big.m") < F.col("m")).withColumn("large", (F.col("m") > 2) & ((F.col("m") > limit) | (F.col("size") > CELL_BYTES)))
        cells = checkpointed(cells)
        done.append(members.join(cells.where("not large").select("cell"), "cell"))
        large = cells.where("large").orderBy(F.desc("m"), "cell").limit(AT_ONCE).collect()
        if not large:
            return reduce(DataFrame.unionByName, done), reduce(DataFrame.unionByName, edges)
        turn += 1
        some = []
        for c in large:
            # of what is outside the largest component, so many in a million
            wanted = min(queries, max(2, QUERY_SHINGLES // len(large) * c.m // max(1, c.n)))
            some.append((c.cell, c.big.label, min(1_000_000, -(-1_000_000 * wanted // (c.m - c.big.m)))))
        some = F.broadcast(spark.createDataFrame(some, "cell long, big long, rate long"))
        chosen = members.join(some, "cell").where((F.col("label") != F.col("big")) & (F.pmod(F.xxhash64("fa", F.lit(turn)), F.lit(1_000_000)) < F.col("rate")))
        pivots = _pivots(chosen.select("cell", "fa", "text").orderBy("fa").collect(), shingle, percent)
        waiting = members.join(cells.where("large").select("cell"), "cell")
        if not pivots:
            members = waiting
            continue
        few = F.broadcast(spark.createDataFrame([(c,) for c in pivots], "cell long"))
        measured = members.join(few, "cell").select("cell", "fa", "label", "text").mapInArrow(released(_measure(spark.sparkContext.broadcast(pivots), shingle, percent)), "kind int, a long, b long, c long, k int, home boolean")
        measured = checkpointed(measured)
        edges.append(measured.where("kind = 0").select("a", "b"))
        for r in measured.where("kind = 2").select("a", "b").distinct().collect():
            group[root(r.a)] = root(r.b)
        places = measured.where("kind = 1").select(F.col("a").alias("cell"), F.col("b").alias("fa"), "c", "k", "home")
        sizes: dict[int, list] = {}
        for r in places.groupBy("cell", "k").agg(F.count("*").alias("m"), F.sum(F.col("home").cast("long")).alias("home")).collect():
            sizes.setdefault(r.cell, []).append((r.m, r.home))
        shrunk = [c for c, x in sizes.items() if sum(m for m, _ in x) <= 1.5 * sum(h for _, h in x) and max(m for m, _ in x) < 0.9 * sum(h for _, h in x)]
        new = F.when(F.col("cell").isin(shrunk or [None]), F.xxhash64("cell", F.lit(turn), "k")).otherwise(F.when(F.col("home"), F.col("cell")))
        places = places.withColumn("new", new).where("new is not null")
        for x in [fa for names, *_ in pivots.values() for fa in names.tolist()]:
            root(x)
        del pivots
        trimmed()
        names = F.broadcast(spark.createDataFrame([(x, root(x)) for x in list(group)], "node long, root long"))
        moved = members.join(places, ["cell", "fa"]).select(F.col("new").alias("cell"), "fa", "n", "text", F.coalesce("c", "label").alias("label"))
        moved = moved.join(names, F.col("label") == F.col("node"), "left").select("cell", "fa", "n", "text", F.coalesce("root", "label").alias("label"))
        members = checkpointed(moved.unionByName(waiting.join(few, "cell", "left_anti").select(moved.columns)))


class Region:
    """The classes of a region and which of them are known to be connected."""

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT):
        self.percent, self.t = percent, 1 - percent / 100
        self.n = np.array([len(s) for s in sets], np.int64)
        every, self.ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        self.mark = np.zeros(len(every), bool)
        self.root = np.arange(len(sets))

    def shared(self, pivot: int, others: np.ndarray) -> np.ndarray:
        """How many elements each of the others shares with the pivot."""
        own = self.ids[self.at[pivot] : self.at[pivot + 1]]
        self.mark[own] = True
        if len(others) == len(self.n):
            out = np.add.reduceat(self.mark[self.ids], self.at[:-1], dtype=np.int64)
        else:
            n = self.n[others]
            i = np.repeat(self.at[others] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            out = np.add.reduceat(self.mark[self.ids[i]], np.concatenate([[0], np.cumsum(n)[:-1]]), dtype=np.int64)
        self.mark[own] = False
        return out

    def measure(self, pivot: int, others: np.ndarray) -> np.ndarray:
        """Distances of others from the pivot; those within reach are connected with it."""
        both = self.shared(pivot, others)
        union = self.n[pivot] + self.n[others] - both
        near = others[100 * both >= self.percent * union]
        roots = np.unique(self.root[np.append(near, pivot)])
        if len(roots) > 1:
            self.root[np.isin(self.root, roots)] = roots[0]
        return 1 - both / union

    def join(self, members: np.ndarray) -> None:
        """Connects the members as far as links between them do."""
        if len(members) < 2 or (self.root[members] == self.root[members[0]]).all():
            return
        if len(members) <= SMALL:
            return self.finish(members, None)
        pivots, table = [int(members[0])], []
        while True:
            table.append(self.measure(pivots[-1], members))
            if (self.root[members] == self.root[members[0]]).all():
                return
            nearest = np.min(table, axis=0)
            far = int(np.argmax(nearest))
            if len(pivots) == PIVOTS or nearest[far] <= 2 * self.t:
                break
            pivots.append(int(members[far]))
        d = np.array(table)
        own = d.min(axis=0)
        cells = [members[row <= own + 2 * self.t + 1e-9] for row in d]
        if sum(len(c) for c in cells) <= 1.5 * len(members) and max(map(len, cells)) < 0.9 * len(members):
            for c in cells:
                self.join(c)
        else:
            self.finish(members, d)

    def finish(self, members: np.ndarray, d: np.ndarray | None) -> None:
        """Every member outside the largest component against those that may be within reach; d: distances from pivots, a row each."""
        roots, count = np.unique(self.root[members], return_counts=True)
        big = roots[np.argmax(count)]
        open_ = np.flatnonzero(self.root[members] != big)
        done = np.zeros(len(members), bool)
        for k in open_.tolist():
            done[k] = True
            p = int(members[k])
            may = ~done & (self.root[members] != self.root[p])
            may &= (100 * self.n[members] >= self.percent * self.n[p]) & (100 * self.n[p] >= self.percent * self.n[members])
            if d is not None:
                may &= (np.abs(d - d[:, k : k + 1]) <= self.t + 1e-9).all(axis=0)
            if may.any():
                self.measure(p, members[may])


def _join_cells(shingle: int, percent: int):
    """Links that connect the classes of each cell as far as they are: a class and the first of its component."""

    def settle(rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        texts = [r[2] for r in rows]
        sets: list[np.ndarray] = []
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        buf = np.frombuffer(b"".join(texts), np.uint8)
        for i, j in blocks(at):
            h, cut = shingle_sets(buf[at[i] : at[j]], at[i : j + 1] - at[i], shingle)
            sets += [h[cut[k] : cut[k + 1]] for k in range(j - i)]
        region = Region(sets, percent)
        region.root = np.unique([r[1] for r in rows], return_inverse=True)[1].astype(np.int64)
        region.join(np.arange(len(rows)))
        name = np.array([r[0] for r in rows], np.int64)
        head = np.full(region.root.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(head, region.root, name)
        head = head[region.root]
        yield pa.RecordBatch.from_arrays([pa.array(name[name != head]), pa.array(head[name != head])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        cell = None
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for c, fa, label, text in zip(batch.column("cell").to_pylist(), batch.column("fa").to_pylist(), batch.column("label").to_pylist(), texts, strict=True):
                if c != cell and rows:
                    yield from settle(rows)
                    rows = []
                cell = c
                rows.append((fa, label, text))
        if rows:
            yield from settle(rows)

    return run


def _components(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, percent: int = PERCENT, cell: int = CELL, queries: int = QUERIES, bits: int = 32) -> DataFrame:
    """The rows of jaccard_components and head, a component's smallest class name: ids can be null or repeated, so they do not tell components apart."""
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    rows = docs.select(field(id_col).cast("long").alias("doc"), document_key(docs, id_col, text_col).alias("key"), field(text_col).alias("text"))
    sent = "part int, bucket int, blob binary"
    exchanged = lambda df, step, schema=sent: df.repartitionById(n, F.col("part")).mapInArrow(released(step), schema)
    fragments = rows.mapInArrow(released(_map_counts(shingle, n * PER_TASK, PER_TASK, bits)), sent)
    facts = checkpointed(exchanged(fragments, _reduce_counts(), FACTS))
    own = facts.where("kind = 0").select("doc", "key", "n", "fa", "fb")
    classes = own.where("n > 0").groupBy("fa", "fb").agg(F.min(F.struct("doc", "key")).alias("lead"), F.max("n").alias("n"))
    held = facts.where("kind = 1").groupBy(F.col("fa").alias("short")).agg(F.sum("n").alias("held"))
    named = classes.withColumn("short", F.shiftrightunsigned("fa", 24)).withColumn("alike", F.count("*").over(Window.partitionBy("short")))
    open_ = named.join(held, "short", "left").where((F.col("held") * 100 >= F.col("n") * percent) | (F.col("alike") > 1)).select("fa", "n", F.col("lead.doc").alias("doc"), F.col("lead.key").alias("key"))
    texts = rows.withColumn("doc", F.coalesce("doc", F.lit(NO_ID))).join(open_, ["doc", "key"]).select("fa", "n", "text").dropDuplicates(["fa"])
    texts = checkpointed(texts)
    held = exchanged(texts.mapInArrow(released(_map_shingles(shingle, n * PER_TASK, PER_TASK)), sent), _reduce_holders(n * PER_TASK, PER_TASK))
    edges = exchanged(exchanged(held, _choose_pivots(percent, n * PER_TASK, PER_TASK)), _reduce_pivots, "a long, b long")
    roots = connected_components(edges)
    regions = texts.join(roots, texts["fa"] == roots["node"]).select(F.col("root").alias("cell"), "fa", "n", "text")
    cells, found = _divided(regions, shingle, percent, cell, queries)
    # by partition number: a repartition by cell would be left out after joins on cell, which may turn into broadcasts when they run
    links = cells.repartitionById(n, F.pmod(F.xxhash64("cell"), F.lit(n)).cast("int")).sortWithinPartitions("cell", "fa").mapInArrow(released(_join_cells(shingle, percent)), "a long, b long")
    heads = connected_components(links.unionByName(found))
    lows = heads.join(classes, heads["node"] == classes["fa"]).groupBy("root").agg(F.min("lead.doc").alias("component"))
    heads = heads.join(lows, "root").select(F.col("node").alias("fa"), F.col("root").alias("head"), "component")
    names = classes.join(heads, "fa", "left").select("fa", "fb", F.coalesce("component", "lead.doc").alias("component"), F.coalesce("head", "fa").alias("head"))
    out = own.join(names, ["fa", "fb"], "left")
    component = F.coalesce("component", "doc")
    plain = lambda c: F.when(c != NO_ID, c)
    return out.select(plain(F.col("doc")).alias("doc_id"), "key", F.col("n").alias("n_shingles"), plain(component).alias("component_id"), "head")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, key (a hash of id and text), n_shingles and component_id.

    Documents link when 100 x shared shingles (of `shingle` words) >= percent x
    shingles of both together; component_id is the smallest id reachable by links. A document
    without words has its own id.
    """
    return _components(docs, id_col, text_col, **options).drop("head")


def near_duplicates_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one document of each component, that of the smallest id (of rows with that id and text: one), and their columns as they were."""
    found = _components(docs, id_col, text_col, **options)
    # a document without words is a component by itself
    empty = F.col("n_shingles") == 0
    rows = found.select(F.when(~empty, F.col("head")).alias("__c"), *[F.when(empty, c).alias(n) for n, c in (("__e", F.coalesce("doc_id", F.lit(NO_ID))), ("__own", F.col("key")))], F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.col("key").alias("k")).alias("s"))
    keep = rows.groupBy("__c", "__e", "__own").agg(F.min("s").alias("s")).select(F.col("s.d").alias("__d"), F.col("s.k").alias("__k"))
    mine = (F.coalesce(field(id_col).cast("long"), F.lit(NO_ID)) == keep["__d"]) & (document_key(docs, id_col, text_col) == keep["__k"])
    # of rows with that id and text the smallest by a hash of all their columns
    left = rowed(docs.join(keep, mine, "left_semi"), __i=field(id_col).cast("long"), __t=field(text_col), __all=F.xxhash64(*[field(c) for c in docs.columns]))
    left = left.groupBy("__i", F.xxhash64("__t").alias("__h")).agg(F.min_by("row", "__all").alias("row"))
    return unrowed(left, docs.columns, [])
