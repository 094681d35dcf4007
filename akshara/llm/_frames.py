"""DataFrame helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stands for a null id inside Python code; it sorts before every other id.
NO_ID = -(1 << 63)


def field(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def rowed(df: DataFrame, **extra: Column) -> DataFrame:
    """All columns in one struct named row, so that no name can clash, and the extra ones beside it."""
    return df.select(F.struct(*[field(c) for c in df.columns]).alias("row"), *[c.alias(k) for k, c in extra.items()])


def unrowed(df: DataFrame, names: list[str], new: list[str]) -> DataFrame:
    """The columns of row again and the new ones; a new one replaces an old one of its name."""
    taken = {c.lower() for c in new}
    return df.select(*[F.col("row").getField(c).alias(c) for c in names if c.lower() not in taken], *new)


def partitions(spark: SparkSession) -> int:
    """How many partitions an exchange gets: as the cluster's operator set it."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage in the shared folder of spark.checkpoint.dir."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder or spark.checkpoint.dir. Only where Spark runs in one process is there another choice."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = f"{tempfile.gettempdir()}/checkpoints"
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def let(value: Column, then) -> Column:
    """then(value), with value computed once a row even where then uses it inside lambdas."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def long(name: str, nullable: bool = True) -> T.StructField:
    return T.StructField(name, T.LongType(), nullable)
