"""Streaming forms: articles seen once, log tails, progress counts, and (an extension) counts per time window.

State is bounded by the watermark; each function takes and returns a streaming
DataFrame and leaves the sink, trigger and checkpoint to the caller.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from akshara.functions import text as X

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def seen_once(stream: DataFrame, key: str, time: str, delay: str = "7 days") -> DataFrame:
    """Any one row of each key within the delay; rows with an empty key all pass and are not kept in state."""
    empty = F.coalesce(F.col(key), F.lit("")) == ""
    marked = stream.withWatermark(time, delay)
    return marked.where(~empty).dropDuplicatesWithinWatermark([key]).unionByName(marked.where(empty))


class FirstSeen(StatefulProcessor):
    """Passes the first row of each key, by order within a batch, and forgets the key a delay after that row's time."""

    def __init__(self, columns: list[str], order: str, time: str | None, delay: int | None):
        self.columns, self.order, self.time, self.delay = columns, order, time, delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0]:  # no key: every row by itself
            yield from (part[self.columns] for part in rows)
            return
        first = None
        for part in rows:
            low = part.loc[[part[self.order].idxmin()]]
            if first is None or low[self.order].iloc[0] < first[self.order].iloc[0]:
                first = low
        if first is None or self.seen.exists():
            return
        self.seen.update((True,))
        if self.delay is not None:
            self.handle.registerTimer(int(first[self.time].iloc[0].timestamp() * 1000) + self.delay)
        yield first[self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        """Nothing is held outside the state."""


def first_seen(stream: DataFrame, key: str, order: str, time: str | None = None, delay_ms: int | None = None) -> DataFrame:
    """The streaming form of first_wins(): of each key the first row that arrives, by order among those that arrive together; rows with an empty key all pass and leave no state.

    With a delay (time: an event-time column with a watermark) a key is
    forgotten once the watermark is so far behind its first row; without one
    state lasts as long as the checkpoint. Passes can follow one another in one
    query. Needs the RocksDB state store, which is set here for the session.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    none = F.coalesce(F.col(key), F.lit("")) == ""
    # rows without a key are spread by their order and meet in no group
    rows = stream.withColumns({"__none": none, "__key": F.when(none, F.col(order).cast("string")).otherwise(F.col(key))})
    processor = FirstSeen(stream.columns, order, time, delay_ms)
    mode = "None" if delay_ms is None else "EventTime"
    return rows.groupBy("__none", "__key").transformWithStateInPandas(processor, stream.schema, "Append", mode, eventTimeColumnName=time if delay_ms is not None else "")


def pages_once(stream: DataFrame, url: str, title: str, order: str, **expiry) -> DataFrame:
    """Pages as a crawl takes them: the first of each address, and of those the first of each title; both keys are normalised, empty ones repeat nothing."""
    rows = stream.withColumns({"url_key": X.url_key(F.col(url)), "title_key": X.normal_key(F.col(title))})
    return first_seen(first_seen(rows, "url_key", order, **expiry), "title_key", order, **expiry)


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of log files as they arrive in a folder, with the name of their file."""
    return spark.readStream.text(folder).select(F.col("value").alias("line"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("log_name"))


def warns(line: Column) -> Column:
    """Whether the log view lists a line among its warnings."""
    return line.rlike("WARNING|FAILED|Traceback|SKIP|Error")


def line_kind(line: Column) -> Column:
    """What a log line reports: a story being generated, a source begun, an article kept or skipped, a warning, articles written, else other."""
    kind = F.when(line.rlike(r"^AI generating [0-9]+/[0-9]+: "), "generating").when(line.rlike("^=== .+? ===$"), "source").when(line.rlike(r"^\s+OK\s"), "kept").when(line.rlike(r"^\s+skip \(.+?\)"), "skipped")
    return kind.when(line.rlike("WARNING|FAILED|Traceback"), "warning").when(line.rlike("^Wrote [0-9]+ article"), "wrote").otherwise("other")


def progress(lines: DataFrame, line: str = "line", by: str = "log_name") -> DataFrame:
    """Lines of each kind of each log; batch or streaming (update or complete mode)."""
    return lines.groupBy(by, line_kind(F.col(line)).alias("kind")).agg(F.count("*").alias("n"))


def window_counts(stream: DataFrame, time: str, by: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Rows of each value of by and tumbling window; rows later than the delay are left out by the watermark."""
    counted = stream.withWatermark(time, delay).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), by, "n")
