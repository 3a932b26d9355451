"""Corpus pipeline over ``documents``: quality, line dedup, near-dedup, mixing, tokens."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillmere.llm import bpe, common, linededup, mixing, quality, simhash
from quillmere.plans.registry import table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    return quality.keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that have a fuzzy copy at an earlier place; documents of which nothing is left go."""
    return linededup.without_duplicate_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.without_near_duplicates(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the Pfair mix; the order stands in the files, where ``tokens`` finds it again."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with its position in the mix."""
    return bpe.encode_documents(mixing.positioned(docs), carry=("position",))


STAGES = [("quality", quality_filter), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", source_mix), ("tokens", tokens)]

#: Scores from a fitted model, near-duplicate sketches, an EDF schedule and BPE are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn; each result is written as Parquet in the shared folder and read again. What a stage wrote on its way, and its input, is deleted then."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        with common.scope():
            following = common.cut(stage(spark, docs, sf_dir), f"pipeline-{name}-{uuid.uuid4().hex[:6]}", keep=True)
        if i:
            common.discard(docs)
        docs = following
    return STAGES[-1][1](spark, docs, sf_dir)
