"""Texts to vectors in batches, through a provider."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from quillmere.sources.providers import Deterministic, Provider

BATCH, MOST_BYTES = 32, 24_000

__all__ = ["BATCH", "MOST_BYTES", "Deterministic", "embed", "embedding_text"]


def embedding_text(heading: Column, content: Column, most: int = MOST_BYTES) -> Column:
    """``heading: content``, at most ``most`` bytes, cut at the last space before that."""
    whole = F.when(F.coalesce(heading, F.lit("")) != "", F.concat(heading, F.lit(": "), F.coalesce(content, F.lit("")))).otherwise(F.coalesce(content, F.lit("")))
    # a prefix of bytes may end inside a character, which becomes a mark that is cut off with the last word
    head = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(whole, "utf-8"), 1, most).cast("string")), "\uFFFD+$", "")
    return F.when(F.octet_length(whole) <= most, whole).otherwise(F.regexp_replace(head, r" [^ ]*$", ""))


def embed(chunks: DataFrame, provider: Provider, heading: str = "heading", content: str = "content", batch: int = BATCH) -> DataFrame:
    """``chunks`` with embedding array<float> and error. A batch that fails is tried text by text; a text that fails has an error and no vector."""
    rows = chunks.withColumn("q_text", embedding_text(F.col(heading), F.col(content)))
    schema, at = rows.schema, len(rows.columns) - 1

    def run(batches):
        for b in batches:
            vectors, errors = [], []
            texts = b.column(at).to_pylist()
            for s in range(0, len(texts), batch):
                part = texts[s : s + batch]
                try:
                    got = provider.embed(part)
                    if len(got) != len(part):
                        raise ValueError(f"{len(got)} vectors for {len(part)} texts")
                    vectors += got
                    errors += [None] * len(part)
                except Exception:  # noqa: BLE001 - a provider may fail in any way
                    for t in part:
                        try:
                            vectors.append(provider.embed([t])[0])
                            errors.append(None)
                        except Exception as e:  # noqa: BLE001
                            vectors.append(None)
                            errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], names=[*schema.names, "embedding", "error"])

    out = rows.mapInArrow(run, Ty.StructType([*schema.fields, Ty.StructField("embedding", Ty.ArrayType(Ty.FloatType())), Ty.StructField("error", Ty.StringType())]))
    return out.drop("q_text")
