"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from akshara.llm._frames import checkpointed


def connected_components(edges: DataFrame) -> DataFrame:
    """node and root (its component's smallest node) of every node of edges (a long, b long).

    Each round joins every node to the smallest neighbour it knows of: first its
    larger neighbours, then its smaller ones. Neighbours are only ever reduced
    by min(), which combines before the shuffle, so a hub is no hot group; each
    round is cut from its lineage in the shared checkpoint folder.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = checkpointed(now)
    size = (-1, -1)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select("b", "low").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        now = checkpointed(small.unionByName(low.select("a", F.col("low").alias("b"))).distinct())
        r = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (r.n, r.s) == size:
            break
        size = (r.n, r.s)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
