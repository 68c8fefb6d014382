"""What the operators of this package share: session settings, scratch tables, words."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave.session import prepare, staging_root

#: Java and Python pattern of one word: whatever stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of whole texts that go to a Python worker at once.
TEXT_ROWS = 256


def ready(spark: SparkSession) -> SparkSession:
    """Pin the settings; batches of whole texts stay small, so that long ones fit."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    return spark


class Scratch:
    """Tables that one call writes to the shared folder.

    A written table cuts the lineage and survives the loss of executors. Tables
    that the returned DataFrame still reads stay; others are dropped when read.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{staging_root(spark)}/{label}-{uuid.uuid4().hex}"
        self.written = 0
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.written += 1
        path = f"{self.root}/{self.written:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(table)))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(column: Column | str) -> Column:
    """Null counts as empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))
