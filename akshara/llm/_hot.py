"""Values that many documents hold, found in a bounded sample of documents.

They only change the plan: which of several equally right keys a string travels
under. A value that the sample misses costs time, never a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from akshara.llm._bytes import blocks, released, utf8

#: Documents of the sample, about, and the share of them from which a value is hot.
SAMPLE, SHARE = 4000, 0.01
#: Hot values at most; the most frequent ones stay.
LIMIT = 200_000


class HotValues:
    """Looks up which of many values are hot; most are turned away by their low 16 bits."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.low = np.zeros(1 << 16, bool)
        self.low[(values & np.uint64(0xFFFF)).astype(np.int64)] = True

    def places(self, x: np.ndarray) -> np.ndarray:
        """Places of the hot values in x."""
        if not len(self.values):
            return np.zeros(0, np.int64)
        at = np.flatnonzero(self.low[(x & np.uint64(0xFFFF)).astype(np.int64)])
        near = self.values[np.minimum(np.searchsorted(self.values, x[at]), len(self.values) - 1)]
        return at[near == x[at]]


def _distinct(values: Callable[[np.ndarray, np.ndarray], np.ndarray], reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = utf8(batch.column("text"))
            for i, j in blocks(offsets, 1 << 20):
                raw, part = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                found = [np.unique(values(raw[a:b], np.array([0, b - a]))) for a, b in zip(part[:-1], part[1:], strict=True) if b - a >= reach]
                if found:
                    v, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)), pa.array(n.astype(np.int64))], ["v", "n"])

    return run


def hot_values(rows: DataFrame, values: Callable[[np.ndarray, np.ndarray], np.ndarray], reach: int):
    """A broadcast sorted array of the hot values, or None; rows: doc, text; values(bytes, offsets) of one text; reach: bytes that one needs."""
    n = rows.count()
    step = max(1, n // SAMPLE)
    least = max(32, int(n / step * SHARE))
    few = rows.where(F.pmod(F.xxhash64("doc"), F.lit(step)) == 0).select("text")
    counts = few.mapInArrow(released(_distinct(values, reach)), "v long, n long").groupBy("v").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "v").limit(LIMIT).select("v").toArrow().column("v").to_numpy()
    return rows.sparkSession.sparkContext.broadcast(np.sort(found.astype(np.uint64))) if len(found) else None
