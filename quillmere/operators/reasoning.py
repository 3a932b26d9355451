"""Multi-round answering over batches of questions: context, prompts, rounds, confidence, structured output.

Model calls are made by a provider inside Arrow batches; everything between them is columns.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.functions.batches import lean, settle
from quillmere.operators import evaluation as E
from quillmere.sources.providers import Provider


def context(sources: Column) -> Column:
    """Sources in order: a head line with number, file, heading, page and kind, then the content."""

    def block(s: Column, i: Column) -> Column:
        head = F.concat(
            F.lit("--- Source "), (i + 1).cast("string"), F.lit(": "), s["filename"],
            F.when(s["heading"] != "", F.concat(F.lit(" | "), s["heading"])).otherwise(F.lit("")),
            F.when(s["page_number"] > 0, F.concat(F.lit(" | Page "), s["page_number"].cast("string"))).otherwise(F.lit("")),
            F.when((s["chunk_type"] != "") & ~s["chunk_type"].isin("paragraph", "section"), F.concat(F.lit(" | ["), s["chunk_type"], F.lit("]"))).otherwise(F.lit("")),
            F.lit(" ---\n"),
        )
        return F.concat(head, s["content"], F.lit("\n\n"))

    return F.concat_ws("", F.transform(sources, block))


def answer_prompt(question: Column, text: Column) -> Column:
    return F.concat(F.lit("Sources:\n"), text, F.lit("\nQuestion: "), question, F.lit("\nAnswer from these sources alone and name them."))


def refinement_prompt(question: Column, answer: Column, text: Column, issues: Column) -> Column:
    return F.concat(F.lit("Sources:\n"), text, F.lit("\nQuestion: "), question, F.lit("\nEarlier answer: "), answer, F.lit("\nIts issues: "), issues, F.lit("\nAnswer again without them."))


def ask(df: DataFrame, prompt: str, out: str, provider: Provider, where: str | None = None, usage: str | None = None) -> DataFrame:
    """Adds ``out`` (the reply) and ``out_error`` for rows where ``where`` holds; a failed call leaves an error, not a failed job.

    ``usage`` names a column for the tokens that the provider says a call took; null if it says nothing.
    """
    schema = df.schema
    names = df.columns

    def run(batches):
        for batch in batches:
            prompts = batch.column(names.index(prompt)).to_pylist()
            wanted = batch.column(names.index(where)).to_pylist() if where else [True] * len(prompts)
            replies, errors, tokens = [], [], []
            for p, w in zip(prompts, wanted, strict=True):
                reply = error = used = None
                if w and p is not None:
                    try:
                        reply = provider.chat(p)
                        used = getattr(provider, "used", None)
                    except Exception as e:  # noqa: BLE001 - a provider may fail in any way; the row says so
                        error = f"{type(e).__name__}: {e}"
                replies.append(reply)
                errors.append(error)
                tokens.append(used)
            more = [pa.array(tokens, pa.int64())] if usage else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(replies, pa.string()), pa.array(errors, pa.string()), *more], names=[*names, out, f"{out}_error", *([usage] if usage else [])])

    from pyspark.sql import types as Ty

    settle(df.sparkSession)  # a row has its sources, its prompt and more, so batches are bounded by bytes
    return df.mapInArrow(lean(run), Ty.StructType([*schema.fields, Ty.StructField(out, Ty.StringType()), Ty.StructField(f"{out}_error", Ty.StringType()), *([Ty.StructField(usage, Ty.LongType())] if usage else [])]))


def reason(questions: DataFrame, provider: Provider, rounds: int = 3, threshold: float = 0.7) -> DataFrame:
    """(…, answer, tokens, confidence, rounds_used): answer; validate; refine if the confidence is under the threshold and rounds are left.

    ``questions``: query_id, question, sources.  A failed refinement keeps the first answer.
    """
    first = ask(questions.withColumn("q_context", context(F.col("sources"))).withColumn("q_prompt", answer_prompt(F.col("question"), F.col("q_context"))), "q_prompt", "answer", provider, usage="tokens")
    first = first.withColumn("answer", F.coalesce("answer", F.lit("")))
    if rounds < 2:
        return first.withColumn("confidence", E.heuristic_confidence(F.col("answer"), F.col("sources"))).withColumn("rounds_used", F.lit(1)).drop("q_context", "q_prompt")
    checked = E.validate(first).withColumn("confidence", F.col("validation_confidence"))
    if rounds < 3:
        return checked.withColumn("rounds_used", F.lit(2)).drop("q_context", "q_prompt")
    again = checked.withColumn("q_again", F.col("confidence") < threshold).withColumn("q_prompt", refinement_prompt(F.col("question"), F.col("answer"), F.col("q_context"), F.col("validation_summary")))
    better = ask(again, "q_prompt", "q_better", provider, "q_again", usage="q_more")
    better = better.withColumn("tokens", F.coalesce(F.col("tokens") + F.col("q_more"), "tokens", "q_more")).drop("q_more")
    out = better.withColumn("rounds_used", F.when(F.col("q_better").isNotNull(), 3).otherwise(2)).withColumn("answer", F.coalesce("q_better", "answer"))
    rescored = E.validate(out.drop("citation_issues", "consistency_issues", "validation_confidence", "validation_summary"))
    return rescored.withColumn("confidence", F.col("validation_confidence")).drop("q_context", "q_prompt", "q_again", "q_better", "q_better_error")


def structured(answers: DataFrame, provider: Provider) -> DataFrame:
    """Adds ``found`` and ``response``: a model's JSON, asked twice, else by phrases."""
    ask1 = F.concat(F.lit('Give JSON with "found" (true or false) and "response" for this answer:\n'), F.col("answer"))
    out = ask(answers.withColumn("q_json", ask1), "q_json", "q_one", provider)
    out = out.withColumn("q_bad", ~_valid(F.col("q_one")))
    out = ask(out, "q_json", "q_two", provider, "q_bad")
    good = F.when(_valid(F.col("q_one")), F.col("q_one")).when(_valid(F.col("q_two")), F.col("q_two"))
    parsed = F.from_json(good, "found boolean, response string")
    return out.withColumn("found", F.coalesce(parsed["found"], E.found(F.col("answer")))).withColumn("response", F.coalesce(parsed["response"], F.col("answer"))).drop("q_json", "q_one", "q_one_error", "q_two", "q_two_error", "q_bad")


def _valid(reply: Column) -> Column:
    return F.coalesce(F.length(F.get_json_object(reply, "$.response")) > 0, F.lit(False))


def salvage_json(reply: Column) -> Column:
    """The outermost braces of a reply, without fences."""
    return F.nullif(F.regexp_extract(F.regexp_replace(reply, "```(?:json)?", ""), r"(?s)(\{.*\})", 1), F.lit(""))


def judge(answers: DataFrame, provider: Provider) -> DataFrame:
    """Adds ``judged``: share of facts that a judging model finds covered; without a usable reply, strict accuracy."""
    facts = F.concat_ws("\n", F.transform("facts", lambda f, i: F.concat((i + 1).cast("string"), F.lit(". "), F.replace(f, F.lit("|"), F.lit(" or ")))))
    prompt = F.concat(F.lit('Which facts does the answer cover? Reply {"covered": [booleans in order]}.\nAnswer: '), F.col("answer"), F.lit("\nFacts:\n"), facts)
    out = ask(answers.withColumn("q_prompt", prompt), "q_prompt", "q_reply", provider)
    covered = F.slice(F.from_json(salvage_json(F.col("q_reply")), "covered array<boolean>")["covered"], F.lit(1), F.greatest(F.size("facts"), F.lit(1)))
    share = F.when(F.size("facts") > 0, F.size(F.filter(covered, lambda x: x)) / F.size("facts"))
    return out.withColumn("judged", F.coalesce(F.round(share, 6), E.accuracy(F.col("answer"), F.col("facts")))).drop("q_prompt", "q_reply", "q_reply_error")


def parse_covered(reply: str) -> list[bool]:
    return [bool(x) for x in json.loads(reply)["covered"]]
