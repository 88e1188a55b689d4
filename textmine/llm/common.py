"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The six ASCII white-space characters that separate words.
WHITE = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    The session's setting is read, then the context's checkpoint folder (which
    tests and the bench set).  Nothing is invented here: without either the
    call fails, because a machine-local folder would lose data on a cluster.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    named = named or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if sc.master.startswith("local["):
        # Single-process sessions (tests, the local gate) own one machine; its
        # warehouse is the folder that all their tasks see.
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.stages"
    raise RuntimeError("spark.checkpoint.dir is not set; name a folder that all executors share")


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Words of a text as an array; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != "")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *cols, least: int = 1) -> DataFrame:
    """Hash-partition by ``cols`` into the session's number of shuffle partitions."""
    return df.repartition(max(least, partitions(df.sparkSession)), *cols)
