"""Chunking: hierarchical chunks of sections with token limits and overlap."""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.functions import text as T

_FIELDS = re.compile(r"[^ \t\n\r\f\v]+")
_SENTENCE = re.compile(r"(?<=[.?!])(?=[ \n\t]|$)")
PREVIEW = 200


def parent_text(heading: Column, content: Column) -> Column:
    """Heading, blank line, and the preview of the content; without a heading the preview alone."""
    return F.concat(F.when(heading != "", F.concat(heading, F.lit("\n\n"))).otherwise(F.lit("")), preview(content))


def preview(content: Column) -> Column:
    """The content's first 200 bytes cut at the last space, with dots if it was cut; without a space, as many characters as fit."""

    def cut(body: Column) -> Column:
        data = body.cast("binary")
        follows = lambda at: F.hex(F.substring(data, at, 1)).rlike("^[89AB]")  # noqa: E731 - a byte inside a character
        fits = F.when(~follows(PREVIEW + 1), PREVIEW)
        for back in (1, 2):
            fits = fits.when(~follows(PREVIEW + 1 - back), PREVIEW - back)
        return T.let(F.substring(data, F.lit(1), fits.otherwise(PREVIEW - 3)).cast("string"), at_space)

    def at_space(head: Column) -> Column:
        last = F.substring_index(head, " ", -1)
        return F.when(F.contains(head, F.lit(" ")), F.left(head, F.length(head) - F.length(last) - 1)).otherwise(head)

    return T.let(T.trimmed(content), lambda body: F.when(F.octet_length(body) > PREVIEW, F.concat(cut(body), F.lit("..."))).otherwise(body))


def estimate(text: str) -> int:
    return math.ceil(len(_FIELDS.findall(text)) * 1.3)


def overlap_of(text: str, tokens: int) -> str:
    """The last words of a text whose estimate is at most ``tokens``."""
    keep = int(tokens / 1.3)
    return " ".join(_FIELDS.findall(text)[-keep:]) if keep else ""


def split_sentences(text: str) -> list[str]:
    return [s for s in (x.strip() for x in _SENTENCE.split(text)) if s]


def _pack(units: list[str], limit: int, overlap: int, glue: str, start: str) -> list[str]:
    """Greedy packing; a new fragment begins with the overlap of the one before."""
    out, text, tokens = [], "", 0
    if start:
        text, tokens = start + glue, estimate(start)
    for unit in units:
        n = estimate(unit)
        if tokens + n > limit and text:
            out.append(text.strip())
            tail = overlap_of(text, overlap)
            text, tokens = (tail + glue, estimate(tail)) if tail else ("", 0)
        if text:
            text += glue
        text += unit
        tokens += n
    if text:
        out.append(text.strip())
    return out


def split_content(text: str, limit: int = 1024, overlap: int = 128, separator: str = "\n\n") -> list[str]:
    """Fragments of at most ``limit`` estimated tokens: paragraphs packed greedily, longer ones by sentences; a single longer sentence stays whole."""
    if estimate(text) <= limit:
        return [text.strip()]
    out: list[str] = []
    text_now, tokens, tail = "", 0, ""
    for para in (p for p in (x.strip() for x in text.split(separator)) if p):
        n = estimate(para)
        if n > limit:
            if text_now:
                out.append(text_now.strip())
                tail, text_now, tokens = overlap_of(text_now, overlap), "", 0
            made = _pack(split_sentences(para), limit, overlap, " ", tail)
            out += made
            if made:
                tail = overlap_of(made[-1], overlap)
            continue
        if tokens + n > limit and text_now:
            out.append(text_now.strip())
            tail = overlap_of(text_now, overlap)
            text_now, tokens = (tail + "\n\n", estimate(tail)) if tail else ("", 0)
        if text_now:
            text_now += "\n\n"
        text_now += para
        tokens += n
    if text_now:
        out.append(text_now.strip())
    return out


def _fragments(limit: int, overlap: int, separator: str):
    @F.arrow_udf("array<string>")
    def split(content: pa.Array) -> pa.Array:
        return pa.array([split_content(t, limit, overlap, separator) if t else [] for t in content.to_pylist()], pa.list_(pa.string()))

    return split


def chunk_sections(sections: DataFrame, limit: int = 1024, overlap: int = 128, separator: str = "\n\n") -> DataFrame:
    """(doc_id, position_in_doc, parent_position, is_parent, section_idx, heading, chunk_type, page_number, content, token_count, content_hash).

    ``sections``: doc_id, section_idx, heading, content, section_type, page_number.  Each section is a parent chunk with a preview, followed by its
    fragments; positions count through the document.  Only the content column goes through Python.
    """
    from pyspark.sql import Window as W

    kind = F.col("section_type")
    parts = sections.withColumn("parts", F.concat(F.array(F.struct(F.lit(True).alias("is_parent"), parent_text(F.coalesce("heading", F.lit("")), F.coalesce("content", F.lit(""))).alias("content"))), F.transform(_fragments(limit, overlap, separator)("content"), lambda x: F.struct(F.lit(False).alias("is_parent"), x.alias("content")))))
    before = F.coalesce(F.sum(F.size("parts")).over(W.partitionBy("doc_id").orderBy("section_idx").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = parts.withColumn("first", before).select("doc_id", "section_idx", "heading", "section_type", "page_number", "first", F.posexplode("parts").alias("i", "part"))
    own = F.when(F.col("part.is_parent"), F.when(kind.isin("table", "definition", "requirement", "paragraph"), kind).otherwise("section")).otherwise(F.when(kind.isin("table", "definition", "requirement"), kind).otherwise("paragraph"))
    return rows.select(
        "doc_id",
        (F.col("first") + F.col("i")).cast("bigint").alias("position_in_doc"),
        F.when(~F.col("part.is_parent"), F.col("first").cast("bigint")).alias("parent_position"),
        F.col("part.is_parent").alias("is_parent"),
        "section_idx",
        "heading",
        own.alias("chunk_type"),
        "page_number",
        F.col("part.content").alias("content"),
        T.token_estimate(T.n_words(F.col("part.content"))).alias("token_count"),
        F.sha2("part.content", 256).alias("content_hash"),
    )


def content_hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def section_chunk_map(chunks: DataFrame) -> DataFrame:
    """(doc_id, section_idx, position_in_doc): the first chunk of every section, to which its images go."""
    return chunks.groupBy("doc_id", "section_idx").agg(F.min("position_in_doc").alias("position_in_doc"))


def metadata_json(meta: Column) -> Column:
    """A map as JSON with sorted keys; an empty or null one is {}."""
    return F.coalesce(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(meta)))), F.lit("{}"))
