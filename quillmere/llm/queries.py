"""Queries of the corpus operators, one an operator, over whole tables with production parameters; and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmere.llm import bpe, linededup, media, mixing, packing, pagediff, quality, rules, simhash, surrogates
from quillmere.plans.registry import table


def op1_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagediff.extract(table(spark, sf_dir, "pages"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents"))


def op5_shard_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.shard_documents(table(spark, sf_dir, "documents"))


def op6_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.stored(table(spark, sf_dir, "documents"))


def rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger's second face: counts by policy and rule, from the bits of the stored ledger alone."""
    return rules.ablation(op7_rule_ledger(spark, sf_dir))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.page_media(table(spark, sf_dir, "pages"))


def op10_bpe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_page_differencing, op2_source_mixing, op3_pii_surrogates, op4_line_dedup, op5_shard_packing, op6_quality_ranking, op7_rule_ledger, rule_ablation, op8_simhash_dedup, op9_jpeg_media, op10_bpe_tokens)}

SQL = {"op7_rule_ledger": rules.ledger_sql(), "rule_ablation": rules.ablation_sql()}
