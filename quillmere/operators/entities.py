"""Entities of a question, and the expansion of terms into the corpus's other languages."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quillmere.functions import text as T
from quillmere.operators import reasoning
from quillmere.sources.providers import Provider

_QUOTED = re.compile(r"\"([^\"]+)\"|'([^']+)'")
_STANDARD = re.compile(r"(?i)^(?:iso|iec|astm|ieee)[-/]?\d*")
_STOPS = frozenset(T.RETRIEVAL_STOPS)


def entities_of(question: str, more: list[str] = ()) -> list[str]:
    """Quoted parts, runs of capitalised words, standards with their numbers, ``Section n.n``, words over three bytes, then ``more``; each once in any case."""
    found = [a or b for a, b in _QUOTED.findall(question)]
    words = [w.strip(T.EDGE_MARKS) for w in question.split()]
    run: list[str] = []
    for w in [*words, ""]:
        if w and w[0].isupper() and w.lower() not in _STOPS:
            run.append(w)
            continue
        if run:
            found.append(" ".join(run))
        run = []
    for i, w in enumerate(words):
        if m := _STANDARD.match(w):
            alone = m.group(0).isalpha() and m.group(0) == w
            found.append(f"{w} {words[i + 1]}" if alone and i + 1 < len(words) and words[i + 1][:1].isalnum() else w)
        if w.lower() == "section" and i + 1 < len(words) and words[i + 1][:1].isdigit():
            found.append(f"Section {words[i + 1]}")
    found += [w for w in words if len(w.encode()) > 3 and w.lower() not in _STOPS]
    found += list(more)
    seen: set[str] = set()
    return [e for e in (x.strip() for x in found) if e and not (e.lower() in seen or seen.add(e.lower()))]


@F.arrow_udf(ArrayType(StringType()))
def _entities(question: pa.Array) -> pa.Array:
    return pa.array([entities_of(q) if q else [] for q in question.to_pylist()], pa.list_(pa.string()))


def query_entities(question: Column) -> Column:
    """``entities_of`` as a column; a null question has none."""
    return _entities(question)


def corpus_languages(documents: DataFrame, column: str = "language") -> DataFrame:
    """Distinct languages other than none and English."""
    return documents.select(F.lower(column).alias("language")).where("language is not null and language not in ('', 'en', 'english')").distinct()


def expand(terms: DataFrame, dictionary: DataFrame, languages: DataFrame) -> DataFrame:
    """(query_id, term, language): the terms, and their translations into the corpus's languages where the dictionary has them.

    ``dictionary`` is the cache of earlier translations: term, language, translation; a null translation says that there is none.
    """
    low = terms.select("query_id", F.lower("term").alias("term"))
    known = dictionary.where("translation is not null").join(languages, "language", "left_semi").select(F.lower("term").alias("term"), "language", "translation")
    other = low.join(known, "term").select("query_id", F.col("translation").alias("term"), "language")
    return low.withColumn("language", F.lit(None).cast("string")).unionByName(other).distinct()


def untranslated(terms: DataFrame, dictionary: DataFrame, languages: DataFrame) -> DataFrame:
    """(term, language) that the cache doesn't know yet: what a model is asked for, and then appended to the cache."""
    grid = terms.select(F.lower("term").alias("term")).distinct().crossJoin(languages)  # languages of a corpus are a handful
    return grid.join(dictionary.select(F.lower("term").alias("term"), "language"), ["term", "language"], "left_anti")


def translated(missing: DataFrame, provider: Provider) -> DataFrame:
    """(term, language, translation) of terms the cache lacks, a model call a language and batch of terms; what it doesn't give is null, which is remembered too."""
    together = missing.groupBy("language", F.pmod(F.xxhash64("term"), F.lit(64)).alias("part")).agg(F.array_sort(F.collect_set("term")).alias("terms"))
    prompt = F.concat(F.lit("Translate each of these terms into "), F.col("language"), F.lit('. Reply with one JSON object alone: {"term": "translation"}.\n'), F.to_json("terms"))
    told = reasoning.ask(together.withColumn("q_prompt", prompt), "q_prompt", "q_reply", provider)
    read = F.from_json(reasoning.salvage_json(F.col("q_reply")), "map<string,string>")
    return told.select("language", read.alias("m"), F.explode("terms").alias("term")).select("term", "language", F.nullif(F.trim(F.try_element_at("m", F.col("term"))), F.lit("")).alias("translation"))
