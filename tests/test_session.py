"""Scans are spread by the rows their splits hold, not by the number of splits."""

import pytest
from pyspark.sql import functions as F

from tripweave.session import widen


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def rows_by_split(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_a_file_of_one_row_group_is_read_by_all_cores(small_splits, tmp_path):
    path = str(tmp_path / "one.parquet")
    small_splits.range(40_000).withColumn("x", F.xxhash64("id")).coalesce(1).write.parquet(path)
    scan = small_splits.read.parquet(path)
    cores = small_splits.sparkContext.defaultParallelism
    assert scan.rdd.getNumPartitions() >= cores and len(rows_by_split(scan)) == 1
    held = rows_by_split(widen(scan))
    assert sum(held) == 40_000 and max(held) * cores <= 2 * sum(held)


def test_a_scan_of_even_splits_is_left_alone(small_splits, tmp_path):
    path = str(tmp_path / "even.parquet")
    cores = small_splits.sparkContext.defaultParallelism
    small_splits.range(40_000).repartition(2 * cores).write.parquet(path)
    scan = small_splits.read.parquet(path)
    assert widen(scan) is scan


def test_an_empty_scan_is_left_alone(small_splits, tmp_path):
    path = str(tmp_path / "none.parquet")
    small_splits.range(40_000).repartition(16).filter("id < 0").write.parquet(path)
    assert widen(small_splits.read.parquet(path)).count() == 0
