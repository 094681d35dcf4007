"""Article files and stage tables.

Exchange files are JSON: an array of articles, or an object with _meta and
articles; a missing, empty or malformed file holds no articles. They are split
among tasks within a file. Stages of a run are Parquet folders
(pipeline, stage, run), committed by Spark's file committer.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from akshara.sources import arrays
from akshara.sources import versions as V

ARTICLE = "title string, link string, date string, source string, listing_url string, body string, fetched_at string, search_keyword string, search_engine string, extractor string, zone_code string, zone_name string, source_lang string, ai_headline string, ai_news_story string, topics array<string>, fact_score int, plagiarism_score int, truncated boolean"
REGISTRY = "name string, category string, language string, notes string, crawl_difficulty string, priority int, start_urls array<string>, search_keywords array<string>"


def read_articles(spark: SparkSession, path: str, schema: str = ARTICLE, part: int = arrays.PART) -> DataFrame:
    """The articles of a JSON file or of each file of a folder, in no order across files.

    A file with an element that is no JSON object holds none at all, so files are
    parsed a second time for such elements; fields of another type are null.
    """
    rows = arrays.read_elements(spark, path, part=part)
    parsed = rows.select("name", "element", F.from_json("element", f"{schema}, __bad string", {"columnNameOfCorruptRecord": "__bad"}).alias("a"))
    no_object = F.try_parse_json("element").isNull() | ~F.col("element").rlike(r"^[ \t\r\n]*\{")
    bad = parsed.where(F.col("a.__bad").isNotNull() & no_object).select("name").distinct()
    return parsed.join(bad, "name", "left_anti").select("a.*").drop("__bad")


def as_fields(schema: str) -> str:
    """name: type, ... of a schema of simple columns."""
    return ", ".join(": ".join(c.strip().split(" ", 1)) for c in schema.split(", "))


def write_articles(df: DataFrame, path: str, meta: dict[str, str] | None = None, keep: int = 10) -> int:
    """The articles as the newest version of the folder path, with the run's facts in its entry; the number of the version. Older ones than the last keep expire."""
    version = V.commit(df, path, meta)
    V.expire(df.sparkSession, path, keep)
    return version


def read_lines(spark: SparkSession, path: str, schema: str = ARTICLE, version: int | None = None) -> DataFrame:
    """The articles of a version (the newest) of a folder that write_articles() wrote, or of plain JSON lines, split among tasks within files; malformed lines hold none."""
    found = V.entries(spark, path)
    if found:
        rows = V.snapshot(spark, path, version)
        wanted = spark.createDataFrame([], schema).schema
        return rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted])
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def read_meta(spark: SparkSession, path: str, version: int | None = None) -> dict[str, str]:
    """The facts of a version (the newest), empty where there are none."""
    found = V.entries(spark, path)
    return dict(found.get(version or max(found, default=0), {}).get("meta", {}))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """One row per source of a registry file: its group, its place there and its fields."""
    files = spark.read.option("wholetext", True).text(path)
    groups = F.from_json("value", f"struct<source_groups: map<string, struct<sources: array<struct<{as_fields(REGISTRY)}>>>>>")["source_groups"]
    rows = files.select(F.explode(groups).alias("group", "g"))
    return rows.select("group", F.posexplode("g.sources").alias("ord", "s")).select("group", "ord", "s.*")


def save_stage(df: DataFrame, root: str, pipeline: str, stage: str, run: str) -> None:
    df.write.mode("overwrite").parquet(f"{root}/pipeline={pipeline}/stage={stage}/run={run}")


def stage_runs(spark: SparkSession, root: str, keep: int = 10) -> DataFrame:
    """pipeline, stage, run, rows, and whether the run is the newest or beyond the last keep ones."""
    rows = spark.read.parquet(root).groupBy("pipeline", "stage", F.col("run").cast("string").alias("run")).agg(F.count("*").alias("rows"))
    n = F.row_number().over(Window.partitionBy("pipeline", "stage").orderBy(F.desc("run")))
    return rows.withColumn("__n", n).select("pipeline", "stage", "run", "rows", (F.col("__n") == 1).alias("newest"), (F.col("__n") > keep).alias("expired"))
