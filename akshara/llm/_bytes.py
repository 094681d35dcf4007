"""Vectorised byte helpers shared by the operators of this subpackage.

Texts are handled as one UTF-8 buffer per Arrow batch with row offsets; words
are maximal runs of bytes other than 0x20 and 0x09-0x0D.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text that are hashed at a time.
BLOCK = 1 << 20
#: Of zstd, for exchanges.
LEVEL = 5
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column (null: empty) and its rows' offsets."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes; a longer row has a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def parts(batch: pa.RecordBatch, texts: pa.Array) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batch in slices of about BLOCK bytes of texts, each with the bytes and offsets of its own."""
    buf, offsets = utf8(texts)
    for i, j in blocks(offsets):
        yield batch.slice(i, j - i), buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each row the number of words before it."""
    solid = ~SPACE[buf]
    n = len(buf)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    left, right = np.ones(n, bool), np.ones(n, bool)
    left[1:] = ~solid[:-1]
    right[:-1] = ~solid[1:]
    start = np.flatnonzero(solid & (left | edge[:-1]))
    end = np.flatnonzero(solid & (right | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that low and high bits are alike random."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over the values, from which span_hash() takes any span."""
    up, _ = _power(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end); equal spans have equal hashes."""
    _, down = _power(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    k, y = 1, x
    while 2 * k <= width:
        y = np.minimum(y[:-k], y[k:])
        k *= 2
    return y[:n] if k == width else np.minimum(y[:n], y[width - k : width - k + n])


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """The arrays as one zstd-compressed string, for an exchange."""
    raw = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    head = np.array([len(raw), *map(len, raw)], np.int64).tobytes()
    body = b"".join([head, *raw])
    return np.int64(len(body)).tobytes() + pa.Codec("zstd", LEVEL).compress(body, asbytes=True)


def unpack(blob: bytes, *kinds: type) -> list:
    """What pack() took; kinds: a dtype for each array, bytes for a string."""
    body = pa.Codec("zstd").decompress(blob[8:], int(np.frombuffer(blob[:8], np.int64)[0]), asbytes=True)
    n = int(np.frombuffer(body[:8], np.int64)[0])
    sizes = np.frombuffer(body[8 : 8 + 8 * n], np.int64)
    out, at = [], 8 + 8 * n
    for kind, size in zip(kinds, sizes, strict=True):
        part = body[at : at + size]
        out.append(part if kind is bytes else np.frombuffer(part, kind))
        at += int(size)
    return out


def merged(start: np.ndarray, stop: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the intervals of each owner; they must be sorted by owner and start, and no stop may fall behind an earlier one of its owner."""
    if not len(start):
        return start, stop, owner
    new = np.ones(len(start), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (start[1:] > stop[:-1])
    first = np.flatnonzero(new)
    return start[first], stop[np.append(first[1:], len(start)) - 1], owner[first]


def trimmed() -> None:
    """Gives freed memory of this process back."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def released(run):
    """The function of a task, which gives freed memory back at its end: a reused worker would hold it through later stages."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trimmed()

    return task
