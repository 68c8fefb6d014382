"""Session defaults and the staging area between pipeline stages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings results depend on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def staging_root(spark: SparkSession) -> str:
    """Shared folder for staged tables: ``spark.checkpoint.dir`` of the session.

    Only a session without that setting (a local test) gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def stage(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the staging area once and return a scan of it.

    Used where several outputs read one expensive table: the written table cuts
    the lineage, survives the loss of executors, and later reads prune columns and
    partitions.
    """
    spark = df.sparkSession
    path = f"{staging_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def widen(df: DataFrame) -> DataFrame:
    """Spread a scan over all cores where few of its splits hold most rows; leave every other
    input alone.

    A small or unsplittable file has fewer splits than there are cores. A larger one may have as
    many and still be read by a few tasks: only the split with the middle of a row group reads it,
    the others are empty. So rows are counted by split, of no column (Parquet tells them from footers).
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    if splits < cores:
        return df.repartition(cores)
    held = df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("rows"))
    most, rows = held.agg(F.max("rows"), F.sum("rows")).first()
    return df.repartition(splits) if rows and most * cores > 2 * rows else df
