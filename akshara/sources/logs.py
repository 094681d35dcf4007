"""Log files as a source that remembers how far it has read each of them.

spark.dataSource.register(LogTail) makes format log_tail: every line of the
files of a folder, once, as rows of line, log_name and at (the byte at which the
line starts, so that at orders the lines of a log). As a stream it goes on where
its checkpoint says: progress is one number a file, the byte behind the last
whole line taken. Lines appended later arrive with a later batch, a line without
its end waits for it, new files join, and a file that has become shorter is read
again from its start. A batch read takes all there is, an unfinished last line
among it.

Ranges of PART bytes are read in tasks of their own. A line belongs to the range
it starts in, so ranges need not end where lines do. Folders may be in any store
that pyarrow opens by its address (file, s3, gs, hdfs).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "line string, log_name string, at long"
#: Bytes of a file that a task reads, and of a read.
PART, READ = 16 << 20, 1 << 20


@dataclass
class Range(InputPartition):
    """Lines that start from start up to stop; the file is not looked at beyond end."""

    name: str
    start: int
    stop: int
    end: int


def opened(path: str) -> tuple[stores.FileSystem, str]:
    """The store of a folder and its path there."""
    if "://" not in path and not path.startswith("file:"):
        return stores.LocalFileSystem(), path.rstrip("/")
    if path.startswith("file:"):
        return stores.LocalFileSystem(), "/" + path.removeprefix("file:").strip("/")
    store, inner = stores.FileSystem.from_uri(path)
    return store, inner.rstrip("/")


def sizes(path: str, suffix: str) -> dict[str, int]:
    """Names and sizes of a folder's files; an absent folder has none."""
    store, inner = opened(path)
    found = store.get_file_info(stores.FileSelector(inner, allow_not_found=True))
    return {f.base_name: f.size for f in found if f.is_file and f.base_name.endswith(suffix)}


def whole_lines(path: str, name: str, size: int) -> int:
    """How many of a file's first size bytes are whole lines, looked for from behind."""
    store, inner = opened(path)
    with store.open_input_file(f"{inner}/{name}") as f:
        stop = size
        while stop > 0:
            start = max(0, stop - READ)
            at = f.read_at(stop - start, start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            stop = start
    return 0


def ranges(name: str, start: int, end: int, part: int) -> list[Range]:
    return [Range(name, a, min(a + part, end), end) for a in range(start, end, part)]


def lines_of(path: str, part: Range) -> Iterator[pa.RecordBatch]:
    """The lines of a range, read in blocks; a line longer than a block grows a buffer of its own length."""
    store, inner = opened(path)
    with store.open_input_file(f"{inner}/{part.name}") as f:
        # a line that has begun before belongs to the range before
        at = part.start
        if at and f.read_at(1, at - 1) != b"\n":
            at = next_line(f, at, part.stop)
        held, begin = b"", at
        while begin < part.stop:
            block = f.read_at(min(READ, part.end - at), at) if at < part.end else b""
            held, at = held + block, at + len(block)
            last = held.rfind(b"\n") + 1
            if not block:
                last = len(held)
                if not held:
                    return
            found = held[:last].split(b"\n")
            if last and held[last - 1 : last] == b"\n":
                found.pop()
            places, texts = [], []
            for text in found if last else []:
                if begin >= part.stop:
                    break
                places.append(begin)
                texts.append(text.removesuffix(b"\r").decode("utf-8", "replace"))
                begin += len(text) + 1
            if texts:
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array([part.name] * len(texts), pa.string()), pa.array(places, pa.int64())], ["line", "log_name", "at"])
            held = held[last:]
            if not block:
                return


def next_line(f, at: int, stop: int) -> int:
    """The start of the first line behind at, or stop where none starts before it."""
    while at < stop:
        block = f.read_at(min(READ, stop - at), at)
        found = block.find(b"\n")
        if found >= 0:
            return at + found + 1
        if not block:
            break
        at += len(block)
    return stop


class _Batch(DataSourceReader):
    def __init__(self, path: str, suffix: str, part: int):
        self.path, self.suffix, self.part = path, suffix, part

    def partitions(self):
        return [r for name, size in sorted(sizes(self.path, self.suffix).items()) for r in ranges(name, 0, size, self.part)] or [Range("", 0, 0, 0)]

    def read(self, partition):
        if partition.end:
            yield from lines_of(self.path, partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str, suffix: str, part: int):
        self.path, self.suffix, self.part = path, suffix, part

    def initialOffset(self):
        return {}

    def latestOffset(self):
        return {name: whole_lines(self.path, name, size) for name, size in sorted(sizes(self.path, self.suffix).items())}

    def partitions(self, start: dict, end: dict):
        out = []
        for name, stop in sorted(end.items()):
            begin = start.get(name, 0)
            out += ranges(name, begin if begin <= stop else 0, stop, self.part)
        return out

    def read(self, partition):
        yield from lines_of(self.path, partition)

    def commit(self, end: dict):
        """Files stay as they are."""


class LogTail(DataSource):
    """Format log_tail. Options: path, suffix of the files' names (any), part (bytes that a task reads)."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def _args(self) -> tuple[str, str, int]:
        if "path" not in self.options:
            raise ValueError("log_tail needs the path of a folder")
        return self.options["path"], self.options.get("suffix", ""), int(self.options.get("part", PART))

    def reader(self, schema) -> DataSourceReader:
        return _Batch(*self._args())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(*self._args())


def tail_logs(spark: SparkSession, folder: str, suffix: str = "", part: int = PART, stream: bool = True) -> DataFrame:
    """Lines of a folder's logs: a stream that goes on where it stopped, or all there is now."""
    spark.dataSource.register(LogTail)
    reader = spark.readStream if stream else spark.read
    return reader.format("log_tail").option("suffix", suffix).option("part", str(part)).load(folder)
