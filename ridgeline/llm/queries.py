"""The registered query of each operator: its whole table, production parameters, its full result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, licenses, multiindex, packing, pii, quotes, sharding, simhash, toxicity, wordpiece
from .common import table


def op1_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op2_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link(table(spark, sf_dir, "conversations"))


def op3_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.search(table(spark, sf_dir, "embeddings"))


def op9_longest_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.count_tokens(table(spark, sf_dir, "documents"))


def op10_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fp_hex().alias("fingerprint"), "component_id")


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii_boosting,
        op2_quotation_links,
        op3_weak_toxicity,
        op4_spaced_seeds,
        op5_extendible_shards,
        op6_best_fit_packing,
        op7_license_rules,
        op8_multi_index,
        op9_longest_match_counts,
        op10_simhash_gray,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_quotation_links": quotes.oracle(),
    "op5_extendible_shards": sharding.oracle(),
}
