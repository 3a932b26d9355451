"""Evaluation runs: whole-document baseline, detection accuracy, reports and their files; summaries of communities."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.operators import evaluation as E
from quillmere.operators import reasoning
from quillmere.sources.providers import Provider

#: A whole document leaves nothing to retrieve, so the confidence of its answers is fixed.
FULL_CONTEXT_CONFIDENCE = 0.8


def full_context(tests: DataFrame, provider: Provider) -> DataFrame:
    """Metrics of answers from whole documents. ``tests``: query_id, question, document, facts and, if wanted, category.

    A test passes by accuracy and faithfulness; retrieval has no part in it.
    """
    source = F.struct(F.lit("document").alias("filename"), F.lit("").alias("heading"), F.col("document").alias("content"), F.lit(0).alias("page_number"), F.lit(0).cast("bigint").alias("chunk_id"), F.lit("").alias("chunk_type"))
    rows = tests.withColumn("sources", F.array(source)).withColumn("q_prompt", reasoning.answer_prompt(F.col("question"), reasoning.context(F.col("sources"))))
    asked = reasoning.ask(rows, "q_prompt", "answer", provider).withColumn("answer", F.coalesce("answer", F.lit(""))).withColumnRenamed("answer_error", "error")
    scored = E.score(asked).withColumn("confidence", F.lit(FULL_CONTEXT_CONFIDENCE))
    return scored.withColumn("passed", (F.col("accuracy") >= 0.5) & (F.col("faithfulness") >= 0.5)).drop("q_prompt", "document", "sources")


def detection_accuracy(found: DataFrame, detected: str, expected: str) -> DataFrame:
    """(n, accuracy): share in percent of rows where what was detected is what was expected."""
    return found.agg(F.count(F.lit(1)).alias("n"), F.round(100 * F.avg((F.col(detected) == F.col(expected)).cast("int")), 6).alias("accuracy"))


def report_text(report: DataFrame, metrics: list[str], name: str = "evaluation") -> str:
    """A report for people: overall first, then by category. ``report`` is that of ``evaluation.report``, a row a category."""
    rows = sorted(report.collect(), key=lambda r: (r["category"] is not None, r["category"] or ""))
    width = max(map(len, metrics), default=0)
    out = [name, "=" * len(name)]
    for r in rows:
        out += ["", f"{r['category'] or 'all'}: {r['passed']}/{r['tests']} passed"]
        out += [f"  {m:<{width}}  {'-' if r[m] is None else format(r[m], '.3f')}" for m in metrics]
    return "\n".join(out)


def write_run(report: DataFrame, results: DataFrame, folder: str, metadata: dict) -> None:
    """``metadata``, ``report`` and ``results`` as JSON below a folder."""
    spark = report.sparkSession
    spark.createDataFrame([(json.dumps(metadata),)], "value string").coalesce(1).write.text(f"{folder}/metadata")
    report.coalesce(1).write.json(f"{folder}/report")
    results.write.json(f"{folder}/results")


def summarise(texts: DataFrame, provider: Provider) -> DataFrame:
    """(level, community, text, summary): a model's summary of each community's members; a failed call leaves the member list."""
    prompt = F.concat(F.lit("Sum up in two sentences what these have in common:\n"), F.col("text"))
    out = reasoning.ask(texts.withColumn("q_prompt", prompt), "q_prompt", "summary", provider)
    return out.withColumn("summary", F.coalesce("summary", "text")).drop("q_prompt", "summary_error")
