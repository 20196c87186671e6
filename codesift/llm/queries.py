"""Registered queries of this package: production parameters over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import clustering, debruijn, extract, minhash, mixing, pitmanyor, quality, quantizer, rotation, sharding, templates, tokens, warc
from .store import Workspace, documents


def op1_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), Workspace(spark, "op1")).select(
        "doc_id", "n_shingles", "component_id", "kept")


def op2_suffix_array_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.decisions(documents(spark, sf_dir))


def op3_systematic_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir), Workspace(spark, "op3"))


def op4_boosted_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "op5")
    archives = warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{work.root}/warc", work)
    return warc.read(spark, archives).drop("url", "valid")


def op6_edit_aware_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.counted(documents(spark, sf_dir))


def op7_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotation.digests(rotation.rotated_dialogues(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op8_debruijn_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.without_repeats(documents(spark, sf_dir), Workspace(spark, "op8"))


def op9_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return templates.leaks(documents(spark, sf_dir), benchmark, Workspace(spark, "op9"))


def op10_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(documents(spark, sf_dir), Workspace(spark, "op10"))


def op11_orchard_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Workspace(spark, "op11"))


def op12_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitmanyor.scored(documents(spark, sf_dir), Workspace(spark, "op12"))


def op13_resident_lloyd_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantizer.coded(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Workspace(spark, "op13"))


QUERIES = {f.__name__: f for f in (
    op1_minhash_near_duplicates, op2_suffix_array_quality, op3_systematic_mixing, op4_boosted_html_extraction,
    op5_warc_round_trip, op6_edit_aware_token_counts, op7_perspective_rotation, op8_debruijn_substring_dedup,
    op9_template_decontamination, op10_hypergeometric_sharding, op11_orchard_clustering,
    op12_pitman_yor_scores, op13_resident_lloyd_codes)}
ORACLES: dict[str, str] = {"op7_perspective_rotation": rotation.ORACLE, "op11_orchard_clustering": clustering.ORACLE,
                           "op13_resident_lloyd_codes": quantizer.ORACLE}
