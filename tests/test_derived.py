"""Inputs derived from the test tables."""

import pytest
from pyspark.sql import functions as F

from codesift.sources import derived as D


@pytest.mark.parametrize("files", [1, 3])
def test_few_row_groups_are_dealt_out_to_all_cores(spark, tmp_path, files):
    """A file has more splits than row groups, and one task would read all rows of a group."""
    path = str(tmp_path / "documents.parquet")
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    rows.repartition(files).write.parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        df = spark.read.parquet(path)
        assert df.rdd.getNumPartitions() >= files
        got = D.documents(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    cores = spark.sparkContext.defaultParallelism
    assert len(got) == cores and max(r["count"] for r in got) < 2 * 4000 / cores


def test_a_source_with_many_files_is_read_as_it_lies(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(4000).repartition(2 * cores).write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.files.openCostInBytes", "100m")
    try:
        assert "Exchange" not in D.spread(spark.read.parquet(str(tmp_path / "t")), "id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
