"""The corpus pipeline: five stages over documents, each the work of one operator.

Toxic documents go, one document of each group of near duplicates stays, words
of repeated windows go from the texts, documents that hold benchmark items go,
and what is left is packed into windows. Each stage reads the Parquet that the
one before it wrote. Nulls, empty texts and repeated rows are treated as the
operators' docstrings say; columns of documents pass unchanged but for text and
n_chars of texts that lose words. Toxicity is not expressible in SQL, so there
is no SQL for run().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from akshara.llm.decontamination import decontaminate
from akshara.llm.jaccard_join import near_duplicates_removed
from akshara.llm.packing import pack_documents
from akshara.llm.substring_dedup import repeats_removed
from akshara.llm.toxicity import nontoxic, train_toxicity
from akshara.llm.warc import shared_folder

ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; the machine learns from labels of documents."""
    machine = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return nontoxic(docs, machine)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, that of the smallest id."""
    return near_duplicates_removed(docs)


def repeated_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of windows that start earlier; a text that loses nothing stays as it is."""
    return repeats_removed(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 ids."""
    out = pack_documents(docs)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_windows", repeated_windows),
    ("benchmark_leaks", benchmark_leaks),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the stages leave of documents."""
    folder = shared_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
