"""WARC archives: a deterministic sharded writer and a reader.

Records are range-sorted by id: shard bounds are quantiles of the ids with the
smallest hashes, a bounded sample that the data alone decide, so equal input
gives equal files. Each shard writes its records, one gzip member each, to files
that roll at a compressed size. A file is written under a temporary name that
holds the task attempt and renamed when it is whole; the manifest, written last
by Spark's committer, names the files that count. What a lost or repeated
attempt leaves behind has another name or the same bytes.

Of records with equal payloads the one with the largest id is the response and
the others are revisit records that refer to it; payloads smaller than
`least_bytes` are all responses. Headers and digests are made anew. A null
payload is empty; a null id sorts first; rows that share the largest id of
their payload are all responses; a null url is left out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from akshara.llm._bytes import utf8
from akshara.llm._frames import NO_ID, field, partitions, shared_root

ROLL_BYTES, LEAST_BYTES = 32 << 20, 0
#: Ids of the sample from which a shard's bounds are taken.
PER_SHARD = 64
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, shard int, records long, bytes long, first_id long, last_id long, sha256 string"
RECORD = T.StructType([T.StructField("id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload", T.BinaryType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType())])


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that all executors share."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or shared_root(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    if not re.match(r"[A-Za-z][\w+.-]*:", uri):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC record; a revisit has the response's HTTP header with the payload's length and no payload."""
    digest = digest32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}:{digest}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20%\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}:{digest}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest32(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(stream) -> Iterator[tuple]:
    """(id, url, payload, payload_bytes, digest, type, refers_to) of each record; the payload of a revisit is None. Raises on a wrong digest."""
    number = lambda x: int(x) if x else None
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()) != b"\r\n":
            k, _, v = line.decode().rstrip("\r\n").partition(": ")
            head[k] = v
        block = stream.read(int(head["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n" or head["WARC-Block-Digest"] != f"sha1:{digest32(block)}":
            raise ValueError(f"damaged record {head['WARC-Record-ID']}")
        http, _, payload = block.partition(b"\r\n\r\n")
        size, digest = int(re.search(rb"Content-Length: (\d+)", http)[1]), head["WARC-Payload-Digest"].removeprefix("sha1:")
        revisit = head["WARC-Type"] == "revisit"
        if not revisit and (len(payload) != size or digest32(payload) != digest):
            raise ValueError(f"damaged payload {head['WARC-Record-ID']}")
        url = head.get("WARC-Target-URI")
        url = None if url is None else re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)) if int(m[1], 16) < 128 else m[0], url)
        yield number(head["WARC-Record-ID"].split(":")[2]), url, None if revisit else payload, size, digest, head["WARC-Type"], number(head["WARC-Refers-To"].split(":")[2]) if revisit else None


def _write(folder: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard = context.partitionId()
        store, root = opened(folder)
        store.create_dir(f"{root}/temporary", recursive=True)
        done: list[tuple] = []
        held, size, ids = io.BytesIO(), 0, []
        mark: tuple | None = None  # (id, payload, what it refers to) of the revisits that follow

        def commit() -> None:
            data = held.getvalue()
            name = f"part-{shard:06d}-{len(done):05d}.warc.gz"
            temporary = f"{root}/temporary/{name}.{context.taskAttemptId()}"
            with store.open_output_stream(temporary, compression=None) as out:
                out.write(data)
            store.move(temporary, f"{root}/{name}")
            done.append((name, shard, len(ids), len(data), ids[0], ids[-1], hashlib.sha256(data).hexdigest()))

        for batch in batches:
            pages, urls, to, kinds, shas = (batch.column(c).to_pylist() for c in ("id", "url", "refers_to", "kind", "sha"))
            buf, offsets = utf8(batch.column("payload"))
            for i, page in enumerate(pages):
                if not kinds[i]:
                    mark = (page, shas[i], to[i])
                    continue
                revisit = mark is not None and mark[:2] == (page, shas[i])
                payload = buf[offsets[i] : offsets[i + 1]].tobytes()
                size += held.write(gzip.compress(record(page, urls[i], payload, mark[2] if revisit else None, revisit), 6, mtime=0))
                ids.append(page)
                if size >= roll:
                    commit()
                    held, size, ids = io.BytesIO(), 0, []
        if ids:
            commit()
        cols = list(zip(*done, strict=True)) or [()] * 7
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], ["file", "shard", "records", "bytes", "first_id", "last_id", "sha256"])

    return run


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", roll_bytes: int = ROLL_BYTES, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes the archives and their manifest below folder, which all executors share, and returns the manifest."""
    spark, n = pages.sparkSession, partitions(pages.sparkSession)
    payload = F.coalesce(field(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(field(id_col).cast("long").alias("id"), field(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    # one small row a page: the largest id of each payload, for payloads that repeat
    small = rows.select("id", "sha", F.octet_length("payload").alias("size"))
    last = small.where(F.col("size") >= least_bytes).groupBy("sha").agg(F.max("id").alias("last_id"), F.count("*").alias("n")).where("n > 1").select("sha", "last_id")
    marks = small.join(last, "sha").where(~F.col("id").eqNullSafe(F.col("last_id"))).select("id", "sha", F.col("last_id").alias("refers_to")).distinct()
    # the marks travel with the pages and sort before them, so that payloads move once
    none = lambda kind: F.lit(None).cast(kind)
    marks = marks.select("id", "sha", F.lit(0).alias("kind"), none("string").alias("url"), none("binary").alias("payload"), "refers_to")
    rows = marks.unionByName(rows.select("id", "sha", F.lit(1).alias("kind"), "url", "payload", none("long").alias("refers_to")))
    ids = pages.select(F.coalesce(field(id_col).cast("long"), F.lit(NO_ID)).alias("id")).distinct()
    sample = sorted(r.id for r in ids.orderBy(F.xxhash64("id"), "id").limit(PER_SHARD * n).collect())
    bounds = np.array([sample[len(sample) * i // n] for i in range(1, n)] if sample else [], np.int64)

    @F.pandas_udf("int")
    def shard(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, x.to_numpy(np.int64), side="right").astype(np.int32))

    rows = rows.withColumn("shard", shard(F.coalesce("id", F.lit(NO_ID))))
    rows = rows.repartitionById(n, F.col("shard")).sortWithinPartitions(F.col("id").asc_nulls_first(), "sha", "kind", "url").drop("shard")
    rows.mapInArrow(_write(folder, roll_bytes), MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with store.open_input_file(f"{root}/{name}") as f, gzip.GzipFile(fileobj=f) as stream:
                    rows, size = [], 0
                    for r in parse(stream):
                        rows.append(r)
                        size += r[3]
                        if size > 8 << 20:
                            yield _records(rows)
                            rows, size = [], 0
                    yield _records(rows)

    return run


def _records(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 7
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], RECORD.names)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the archives that the manifest names: id, url, payload (null for a revisit), payload_bytes, payload_digest, record_type, refers_to."""
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("file")
    return files.repartition(partitions(spark), "file").mapInArrow(_read(folder), RECORD)
