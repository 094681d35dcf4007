"""Runs compared with one another, and stages that no longer follow from their inputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from akshara.operators import articles as A
from akshara.operators import stories as S

SCORES = ("coverage_score", "number_precision", "fact_score", "plagiarism_score")
#: Hexadecimal digits of a row's md5 that a fingerprint adds up, in two parts.
DIGITS = 13


def run_summary(df: DataFrame, run: str = "run", body: str = "body") -> DataFrame:
    """One row a run: articles, median_body (the upper one, 0 for none), means of the scores to one place (null ones left out), gates_failed and sources (zones where there is none). Scores that df lacks are null."""
    has = set(df.columns)
    mean = lambda c: (F.bround(F.avg(F.col(c).cast("double")), 1) if c in has else F.lit(None).cast("double")).alias(c)
    failed = F.count_if(F.coalesce(~F.col("gates_passed"), F.lit(False))) if "gates_passed" in has else F.lit(0).cast("long")
    source = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("source", "zone_code") if c in has], F.lit(""))
    out = df.groupBy(run).agg(F.count("*").alias("articles"), *[mean(c) for c in SCORES], failed.alias("gates_failed"), F.countDistinct(source).alias("sources"))
    middle = S.upper_median(df, [run], F.length(F.coalesce(body, F.lit(""))))
    return out.join(middle.withColumnRenamed("upper_median", "median_body"), run, "left")


def newest_run(runs: DataFrame, label: str, order: str) -> DataFrame:
    """The row of the largest order of each label."""
    row = F.struct(*[F.col(c) for c in runs.columns])
    return runs.groupBy(label).agg(F.max_by(row, F.col(order)).alias("r")).select("r.*")


def config_differences(runs: DataFrame, run: str, config: str) -> DataFrame:
    """key and settings (run, value of the runs that have it, in order) of every key of the runs' configurations (string maps) that is not the same in all; a run without a key differs from one with it. One run each row; the comparison is of a few."""
    rows = runs.select(F.col(run).alias("run"), F.explode(F.coalesce(F.map_entries(config), F.array().cast("array<struct<key:string,value:string>>"))).alias("e"))
    total = runs.agg(F.count("*").alias("total"))
    per = rows.groupBy("e.key").agg(F.array_sort(F.collect_list(F.struct("run", F.col("e.value").alias("value")))).alias("settings"))
    same = F.size(F.array_distinct(F.transform("settings", lambda s: F.coalesce(s["value"], F.lit("null"))))) == 1
    return per.join(F.broadcast(total)).where(~(same & (F.size("settings") == F.col("total")))).select("key", "settings")


def row_text(columns: list[tuple[str, T.DataType]]) -> Column:
    """Each value behind its length, so that no two rows read alike; null is a mark of its own."""
    texts = [F.col(c).cast("string") if not isinstance(t, T.ArrayType | T.MapType | T.StructType) else F.to_json(F.struct(c)) for c, t in columns]
    return F.concat(*[F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in texts])


def fingerprint(df: DataFrame) -> DataFrame:
    """One row, fingerprint: rows and two sums over the md5 of each row, by columns in the order of their names. Equal for equal rows in whatever order, files and partitions; repeated rows count."""
    columns = sorted((f.name, f.dataType) for f in df.schema)
    digest = F.md5(row_text(columns))
    part = lambda k: F.coalesce(F.sum(F.conv(F.substring(digest, 1 + k * DIGITS, DIGITS), 16, 10).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string")
    return df.agg(F.concat_ws("-", F.count("*").cast("string"), part(0), part(1)).alias("fingerprint"))


def fingerprints(tables: dict[str, DataFrame]) -> DataFrame:
    """name and fingerprint of tables."""
    return reduce(DataFrame.unionByName, [fingerprint(df).select(F.lit(name).alias("name"), "fingerprint") for name, df in tables.items()])


def manifest(inputs: dict[str, list[str]], now: DataFrame) -> DataFrame:
    """stage, input and seen: the fingerprints that the inputs (tables or other stages) of each stage had when it ran; a run's few rows."""
    pairs = [(stage, name) for stage, names in inputs.items() for name in names]
    rows = now.sparkSession.createDataFrame(pairs, "stage string, name string")
    return rows.join(now, "name", "left").select("stage", F.col("name").alias("input"), F.col("fingerprint").alias("seen"))


def stale_stages(seen: DataFrame, now: DataFrame) -> DataFrame:
    """stage, because (the smallest input that differs or is itself stale) and depth (1: an input has changed or gone; more: so many steps behind such a stage).

    seen: manifest(); now: name and fingerprint of what there is. A stage that
    is gone or whose inputs are not what it saw is stale, and so is every stage
    behind it, whatever it looks like: it was made of something that will change.
    Each round takes one step along the graph of stages.
    """
    edges = A.checkpointed(seen.select("stage", "input", "seen"))
    state = edges.join(now, F.col("input") == F.col("name"), "left")
    changed = state.where(~F.col("fingerprint").eqNullSafe(F.col("seen")) | F.col("fingerprint").isNull())
    found = A.checkpointed(changed.groupBy("stage").agg(F.min("input").alias("because")).withColumn("depth", F.lit(1)))
    reached, depth = found, 1
    while not reached.isEmpty():
        depth += 1
        behind = edges.join(reached.select(F.col("stage").alias("input")), "input").join(found.select("stage"), "stage", "left_anti")
        reached = A.checkpointed(behind.groupBy("stage").agg(F.min("input").alias("because")).withColumn("depth", F.lit(depth)))
        found = A.checkpointed(found.unionByName(reached))
    return found
