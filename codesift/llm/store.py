"""Written intermediate tables of an operator."""

from __future__ import annotations

from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession

from ..session import scratch

CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Workspace:
    """A folder of written tables below the one the cluster shares; they survive lost executors.

    A table cuts the lineage, so the shuffle files behind it are let go as soon as it is written, and a table
    that nothing needs any more can be dropped.  What an operator returns must be lazy over tables it keeps.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark, self.root = spark, scratch(spark, purpose)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        before = self.spark.conf.get(CLEAN, "false")
        self.spark.conf.set(CLEAN, "true")
        try:
            df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        finally:
            self.spark.conf.set(CLEAN, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(rdd: RDD) -> None:
    """Let the next action write an RDD to the folder the cluster shares; a session without one gets one of ours."""
    sc = rdd.ctx
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(scratch(SparkSession.getActiveSession(), "checkpoints"))
    rdd.checkpoint()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
