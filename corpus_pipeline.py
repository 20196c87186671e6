"""A training-data pipeline over documents: stages that each write Parquet for the next one.

Each stage takes (spark, docs, sf_dir).  All but the last return the columns of docs, whatever they are; rows are
told apart by 128 bits of hashes of all their columns, so repeated ids, null ids and extra columns do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from codesift.llm import minhash, mixing, quality, sharding, templates
from codesift.llm.store import Workspace, documents

KEY, KEY2 = "_row_key_of_the_pipeline", "_second_key_of_the_pipeline"


def keyed(docs: DataFrame) -> DataFrame:
    """Two hashes: one finds a row, both together tell different rows apart (some 1e-17 of 1e11 rows share both)."""
    return docs.withColumns({KEY: F.xxhash64(*docs.columns), KEY2: F.xxhash64(F.lit("second"), *docs.columns)})


def apply_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, those with null or empty texts among them; the others stay as they are.

    Each row is judged by its own text alone, so repeated rows, ties of ids and null ids make no difference.
    """
    return quality.passing(docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest doc_id, once.

    A document without a doc_id stays if no document with one is in its group.  Documents without words have no
    near-duplicates; of equal rows one stays, of rows with one doc_id and different texts in a group all that bear its
    smallest id.
    """
    rows = keyed(docs)
    kept = minhash.near_duplicates(rows, Workspace(spark, "dedup"), KEY).filter("kept").select(
        F.col("key").alias(KEY)).distinct()
    left = rows.join(kept, KEY, "left_semi")
    first = Window.partitionBy(KEY, KEY2).orderBy("doc_id")  # equal rows
    return left.withColumn("_first_of_rows", F.row_number().over(first)).filter("_first_of_rows = 1").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, all rows with their text; null and empty texts hold none and stay."""
    rows = keyed(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = templates.leaks(rows.select(F.col(KEY).alias("doc_id"), "text"), benchmark, Workspace(spark, "decontaminate"))
    bad = leaks.select(F.col("doc_id").alias(KEY)).distinct()
    return rows.join(bad, KEY, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    A null source is a source, a null text has no words; equal rows share the copies of all of them.
    """
    rows = keyed(docs)
    taken = mixing.mixed(rows, Workspace(spark, "mix"), (KEY, KEY2)).groupBy(KEY, KEY2).agg(
        F.sum("copies").alias("_copies_taken"))
    # equal rows share their copies: the first of them carries all
    place = F.row_number().over(Window.partitionBy(KEY, KEY2).orderBy("doc_id"))
    left = rows.join(taken.filter("_copies_taken > 0"), [KEY, KEY2]).withColumn("_first_of_rows", place)
    left = left.filter("_first_of_rows = 1").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies_taken"))))
    return left.select(*docs.columns)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row, nulls, empty texts and copies included; equal rows are rows of their own."""
    return sharding.sharded(docs, Workspace(spark, "shard"))


STAGES = [
    ("quality rules", apply_quality),
    ("near-duplicates", remove_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: suffix arrays, near-duplicates and hypergeometric draws are not expressed in SQL; tests/llm has brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    work, docs = Workspace(spark, "pipeline"), documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES):
        docs = work.put(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
