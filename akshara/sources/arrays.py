"""JSON arrays split among tasks within a file, and written as one file by many.

A file holds an array, or an object one of whose keys holds it. Two things must
be known to cut it at a byte: whether the byte is inside a string, and how deep
it is nested. Every range of PART bytes is summed up for both cases of the
first (strings that end in it, and the change of depth from outside or inside a
string); running sums over a file's ranges then give each range its own state,
and a second reading finds the elements. An element belongs to the range that
holds the bracket or comma before it, and is read on beyond the range to its
end. Ranges of a file and their sums are rows, a few numbers for PART bytes.

A file whose strings or brackets do not close, or that has a second outermost
bracket, holds no elements; neither does
an absent folder, an empty file, or an object without the key (of a key that
comes twice the last counts, as for any JSON reader). Elements are checked by
who parses them. Folders may be in any store that logs.opened() knows; writing
in place needs a mounted one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from akshara.sources import logs

#: Bytes of a range, and of a look beyond or before it.
PART, LOOK = 4 << 20, 1 << 16
RANGE = "name string, start long, stop long, size long"
QUOTE, BACKSLASH, COMMA, COLON = (ord(c) for c in "\"\\,:")
#: The change of depth that a byte makes outside strings.
STEP = np.zeros(256, np.int8)
STEP[[ord("["), ord("{")]], STEP[[ord("]"), ord("}")]] = 1, -1
SPACE = b" \t\r\n"


def files_of(path: str, suffix: str) -> tuple[str, list[tuple[str, int]]]:
    """The folder of a path, and the names and sizes of its files with bytes (of that file alone where the path is one's); hidden ones do not count."""
    store, inner = logs.opened(path)
    if store.get_file_info(inner).is_file:
        path = path.rstrip("/").rsplit("/", 1)[0]
        found = {inner.rsplit("/", 1)[1]: store.get_file_info(inner).size}
    else:
        found = logs.sizes(path, suffix)
    return path, [(n, s) for n, s in sorted(found.items()) if s and not n.startswith(("_", "."))]


def ranges(spark: SparkSession, files: list[tuple[str, int]], part: int) -> DataFrame:
    """Ranges of files; the list of files alone is the driver's."""
    rows = spark.createDataFrame(files, "name string, size long")
    rows = rows.select("name", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(part).cast("long"))).alias("start"))
    return rows.select("name", "start", F.least(F.col("start") + part, "size").alias("stop"), "size")


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """Ranges, n in all, dealt to tasks anew: a file's ranges to many, up to 16 of them to a task."""
    tasks = min(n, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 16))
    return rows.repartition(max(tasks, 1), "name", "start")


def quotes(data: np.ndarray, before: int) -> np.ndarray:
    """Places of the quotes that open or close a string: those after an even number of backslashes; before: how many end just ahead of data."""
    at = np.flatnonzero(data == QUOTE)
    slash = np.flatnonzero(data == BACKSLASH)
    if not len(at) or not (len(slash) or before):
        return at
    # the place of the last byte before a quote that is no backslash: the run's start is one behind it
    first = np.flatnonzero(np.diff(slash, prepend=-2) != 1)
    run_of = np.searchsorted(slash, at) - 1
    ends_here = (run_of >= 0) & (slash[np.maximum(run_of, 0)] == at - 1) if len(slash) else np.zeros(len(at), bool)
    n = np.zeros(len(at), np.int64)
    if len(slash):
        run = np.searchsorted(first, run_of[ends_here], side="right") - 1
        begin = slash[first[run]]
        n[ends_here] = at[ends_here] - begin + np.where(begin == 0, before, 0)
    n[at == 0] = before
    return at[n % 2 == 0]


def slashes_before(f, at: int) -> int:
    """How many backslashes end just ahead of a file's byte at."""
    n = 0
    while at > 0:
        block = f.read_at(min(LOOK, at), max(0, at - LOOK))
        own = len(block) - len(block.rstrip(b"\\"))
        n, at = n + own, at - len(block)
        if own < len(block):
            break
    return n


def marks(data: np.ndarray, before: int, inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool, int]:
    """Of a block: places of brackets, commas and colons outside strings, the byte at each, the depth behind it; and the state behind the block."""
    ends = quotes(data, before)
    at = np.flatnonzero((STEP[data] != 0) | (data == COMMA) | (data == COLON))
    at = at[(np.searchsorted(ends, at) + inside) % 2 == 0]
    kind = data[at]
    after = depth + np.cumsum(STEP[kind], dtype=np.int64)
    return at, kind, after, bool((len(ends) + inside) % 2), int(after[-1]) if len(after) else depth


def sums(path: str):
    """For mapInPandas: the sums of ranges."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, inner = logs.opened(path)
        for batch in batches:
            for r in batch.itertuples(index=False):
                with store.open_input_file(f"{inner}/{r.name}") as f:
                    data = np.frombuffer(f.read_at(r.stop - r.start, r.start), np.uint8)
                    before = slashes_before(f, r.start)
                    head = f.read_at(LOOK, 0).lstrip(SPACE)[:1] if r.start == 0 else b""
                ends = quotes(data, before)
                steps = np.flatnonzero(STEP[data] != 0)
                odd = np.searchsorted(ends, steps) % 2 == 1
                ways = [np.cumsum(STEP[data[steps[side]]], dtype=np.int64) for side in (~odd, odd)]
                out = {"strings": len(ends) % 2, "head": head.decode("latin-1")}
                for name, way in zip(("outside", "inside"), ways, strict=True):
                    least = int(way.min(initial=0))
                    out |= {name: int(way[-1]) if len(way) else 0, f"{name}_least": least, f"{name}_ends": int(((way == least) & (np.diff(way, prepend=0) < 0)).sum())}
                yield pd.DataFrame([{"name": r.name, "start": r.start, "stop": r.stop, "size": r.size} | out])

    return run


def states(rows: DataFrame, path: str) -> DataFrame:
    """Ranges of files whose strings and brackets close, with the state that each starts in: inside (a string), depth, head (the file's first byte that is no space)."""
    numbers = "strings long, outside long, outside_least long, outside_ends long, inside long, inside_least long, inside_ends long, head string"
    found = rows.mapInPandas(sums(path), f"{RANGE}, {numbers}")
    so_far = Window.partitionBy("name").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("name")
    found = found.withColumn("in", F.coalesce(F.sum("strings").over(so_far), F.lit(0)) % 2 == 1)
    pick = lambda x: F.when(F.col("in"), F.col("inside" + x)).otherwise(F.col("outside" + x))
    found = found.withColumns({"change": pick(""), "least": pick("_least"), "ends": pick("_ends")}).withColumn("depth", F.coalesce(F.sum("change").over(so_far), F.lit(0)))
    closed = (F.sum("strings").over(whole) % 2 == 0) & (F.sum("change").over(whole) == 0) & (F.min(F.col("depth") + F.col("least")).over(whole) >= 0)
    # one outermost bracket
    closed &= F.sum(F.when(F.col("depth") + F.col("least") == 0, F.col("ends")).otherwise(0)).over(whole) == 1
    found = found.withColumns({"closed": closed, "head": F.max("head").over(whole)})
    return found.where("closed").select("name", "start", "stop", "size", F.col("in").alias("inside"), "depth", "head")


def keys(path: str):
    """For mapInPandas: the keys of the outermost object whose colon a range holds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, inner = logs.opened(path)
        for batch in batches:
            for r in batch.itertuples(index=False):
                with store.open_input_file(f"{inner}/{r.name}") as f:
                    data = np.frombuffer(f.read_at(r.stop - r.start, r.start), np.uint8)
                    at, kind, after, _, _ = marks(data, slashes_before(f, r.start), r.inside, r.depth)
                    for p in at[(kind == COLON) & (after == 1)].tolist():
                        end = r.start + p
                        text = f.read_at(min(LOOK, end), max(0, end - LOOK)).rstrip(SPACE)
                        value = f.read_at(LOOK, end + 1).lstrip(SPACE)[:1]
                        yield pd.DataFrame({"name": [r.name], "at": [end], "before": [text.decode("utf-8", "replace")], "opens": [value.decode("latin-1")]})

    return run


def elements_of(path: str):
    """For mapInPandas: the elements whose bracket or comma a range holds, between the bytes begin and until of the file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, inner = logs.opened(path)
        for batch in batches:
            for r in batch.itertuples(index=False):
                with store.open_input_file(f"{inner}/{r.name}") as f:
                    raw = f.read_at(r.stop - r.start, r.start)
                    at, kind, after, inside, depth = marks(np.frombuffer(raw, np.uint8), slashes_before(f, r.start), r.inside, r.depth)
                    begins, ends = bounds(at, kind, after, r.level)
                    mine = (begins + r.start >= r.begin) & (begins + r.start < r.until)
                    begins = begins[mine]
                    if not len(begins):
                        continue
                    # an end closes the last begin before it
                    stops = np.append(ends, -1)[np.searchsorted(ends, begins, side="right")]
                    texts = [raw[b + 1 : e] for b, e in zip(begins.tolist(), stops.tolist(), strict=True) if e >= 0]
                    places = (begins[stops >= 0] + r.start).tolist()
                    if (stops < 0).any():
                        texts.append(raw[begins[-1] + 1 :] + rest(f, r.stop, r.size, r.level, inside, depth))
                        places.append(int(begins[-1]) + r.start)
                for i in range(0, len(texts), 1024):
                    yield pd.DataFrame({"name": r.name, "at": places[i : i + 1024], "element": [t.decode("utf-8", "replace") for t in texts[i : i + 1024]]})

    return run


def bounds(at: np.ndarray, kind: np.ndarray, after: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that an element of a depth starts behind, and places that one ends before."""
    comma = (kind == COMMA) & (after == level)
    return at[comma | ((kind == ord("[")) & (after == level))], at[comma | ((kind == ord("]")) & (after == level - 1))]


def rest(f, at: int, size: int, level: int, inside: bool, depth: int) -> bytes:
    """What of an element lies behind the byte at."""
    out = []
    while at < size:
        raw = f.read_at(min(LOOK, size - at), at)
        places, kind, after, inside, depth = marks(np.frombuffer(raw, np.uint8), slashes_before(f, at), inside, depth)
        _, ends = bounds(places, kind, after, level)
        if len(ends):
            out.append(raw[: ends[0]])
            break
        out.append(raw)
        at += len(raw)
    return b"".join(out)


def read_elements(spark: SparkSession, path: str, key: str = "articles", suffix: str = "", part: int = PART) -> DataFrame:
    """name (of the file), at (a place in it, in the elements' order) and element (its JSON) of a folder's arrays, or of the arrays that key holds in its objects."""
    path, files = files_of(path, suffix)
    n = sum(-(-size // part) for _, size in files)
    rows = dealt(states(dealt(ranges(spark, files, part), n), path), n)
    bare = rows.where("head = '['").select("name", "start", "stop", "size", "inside", "depth", F.lit(0).cast("long").alias("begin"), F.col("size").alias("until"), F.lit(1).alias("level"))
    objects = rows.where("head = '{'")
    held = objects.select("name", "start", "stop", "inside", "depth").mapInPandas(keys(path), "name string, at long, before string, opens string")
    # a key's value lasts to the next key; a quote behind a backslash does not open a key
    following = F.lead("at").over(Window.partitionBy("name").orderBy("at"))
    quoted = json.dumps(key, ensure_ascii=False)
    is_key = F.endswith("before", F.lit(quoted)) & F.substring("before", -len(quoted) - 1, 1).isin("{", ",", *SPACE.decode())
    named = held.withColumn("until", following).where(is_key).groupBy("name").agg(F.max(F.struct("at", "until", "opens")).alias("x"))
    named = named.where("x.opens = '['")
    wrapped = objects.join(named, "name").select("name", "start", "stop", "size", "inside", "depth", F.col("x.at").alias("begin"), F.coalesce("x.until", "size").alias("until"), F.lit(2).alias("level"))
    wrapped = wrapped.where((F.col("stop") > F.col("begin")) & (F.col("start") < F.col("until")))
    found = bare.unionByName(dealt(wrapped, n)).mapInPandas(elements_of(path), "name string, at long, element string")
    # the one blank element of an empty array
    return found.where(F.col("element").rlike(r"[^ \t\r\n]"))


def write_array(df: DataFrame, file: str, key: str | None = None, meta: dict[str, str] | None = None) -> int:
    """df's rows as one JSON array in a file, each partition at its own place in it, and how many bytes it has; with key the array is that key's value beside _meta.

    Tasks write at places that sums of lengths give, so one that runs twice
    writes the same again. The array stands under a temporary name until it is
    whole. df must be the same whenever it is read (a table, a checkpoint).
    """
    store, inner = logs.opened(file)
    if not isinstance(store, logs.stores.LocalFileSystem):
        raise ValueError(f"an array is written in place, which needs a mounted folder and not {file}")
    head = f"{{\"_meta\": {json.dumps(meta or {})}, {json.dumps(key)}: [\n" if key else "[\n"
    lines = df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias("line"), F.spark_partition_id().alias("part"))
    # every line but the first is led by a comma
    lengths = lines.groupBy("part").agg(F.sum(F.octet_length("line") + 2).alias("bytes")).orderBy("part").collect()
    begins, at = {}, len(head.encode())
    for r in lengths:
        begins[r.part] = at
        at += r.bytes
    store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    target = f"{inner}.writing"
    first = min(begins, default=None)
    with open(target, "wb") as f:
        f.write(head.encode())
        f.seek(at)
        f.write(b"]}" if key else b"]")
        size = f.tell()

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        written = None
        with open(target, "r+b") as f:
            for batch in batches:
                for part, line in zip(batch["part"], batch["line"], strict=True):
                    if written is None:
                        f.seek(begins[part])
                        written = 0
                    f.write((b" " if part == first and not written else b",") + line.encode() + b"\n")
                    written += 1
        yield pd.DataFrame({"n": [written or 0]})

    lines.mapInPandas(write, "n long").write.format("noop").mode("overwrite").save()
    store.move(target, inner)
    return size
