"""Corpus views over scored files: rule frequencies, grades, worst files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .score import catalogue


def rule_frequency(found: DataFrame, n_files: DataFrame) -> DataFrame:
    """Hits, files hit and share of files for every rule, also those without hits.

    found(file_id, key); n_files holds one row with column n.  Counting per
    (rule, file) first keeps the distinct count free of a third shuffle key.
    """
    per_file = found.groupBy("key", "file_id").agg(F.count(F.lit(1)).alias("h"))
    per_rule = per_file.groupBy("key").agg(F.sum("h").alias("hits"), F.count(F.lit(1)).alias("files_hit"))
    rules = catalogue(found.sparkSession).select("key", "rule")
    return rules.join(per_rule, "key", "left").crossJoin(F.broadcast(n_files)).select(
        "key", "rule", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("files_hit", F.lit(0)).alias("files_hit"),
        F.round(F.coalesce("files_hit", F.lit(0)) / F.col("n"), 6).alias("share"))


def grades_by_language(scored: DataFrame) -> DataFrame:
    return scored.groupBy("language", "grade").agg(
        F.count(F.lit(1)).alias("files"), F.round(F.avg("score"), 6).alias("mean_score"))


def worst_files(scored: DataFrame, by: str, k: int) -> DataFrame:
    """The k lowest scores of each group; Spark limits the groups before the shuffle."""
    order = Window.partitionBy(by).orderBy("score", "file_id")
    return scored.select(by, "file_id", "score").withColumn(
        "position", F.row_number().over(order)).filter(F.col("position") <= k)
