"""Marks of images in the text of their sections."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmere.sources.providers import Provider


def largest(images: DataFrame) -> DataFrame:
    """Adds ``is_largest``: of the images of one page (or of one section where pages aren't known) the first of greatest area."""
    group = ["path", F.when(F.col("page_number") > 0, F.concat(F.lit("p"), "page_number")).otherwise(F.concat(F.lit("s"), "section_idx"))]
    order = F.row_number().over(W.partitionBy(*group).orderBy(F.desc(F.col("width").cast("bigint") * F.col("height")), "section_idx", "image_idx"))
    return images.withColumn("is_largest", order == 1)


PROMPT = "Say in one sentence what this image shows, with all text that can be read in it."


def captioned(images: DataFrame, provider: Provider, prompt: str = PROMPT) -> DataFrame:
    """Adds ``caption``: what a model that sees says of the largest image of each page; null for others, on failure, and if the provider can't see.

    Only the largest images' bytes reach Python; the rest of a row stays where it is.
    """
    if not hasattr(provider, "see"):
        return images.withColumn("caption", F.lit(None).cast("string"))

    @F.arrow_udf("string")
    def tell(mime: pa.Array, data: pa.Array) -> pa.Array:
        out = []
        for m, d in zip(mime.to_pylist(), data.to_pylist(), strict=True):
            try:
                out.append(provider.see(prompt, [(m or "image/png", d)]) if d else None)
            except Exception:  # noqa: BLE001 - a provider may fail in any way; the image then has no caption
                out.append(None)
        return pa.array(out, pa.string())

    wanted = largest(images)
    return wanted.withColumn("caption", tell("mime", F.when(F.col("is_largest"), F.col("data")))).drop("is_largest")


def with_marks(sections: DataFrame, images: DataFrame, caption: str | None = None) -> DataFrame:
    """Sections whose content ends in a mark for each of their images: the largest of a page with its caption (column ``caption``), the others bare."""
    text = F.coalesce(F.col(caption), F.lit("")) if caption else F.lit("")
    mark = F.when(F.col("is_largest") & (text != ""), F.concat(F.lit("\n[Image: "), text, F.lit("]"))).otherwise(F.lit("\n[image]"))
    marks = largest(images).groupBy("path", "section_idx").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct(~F.col("is_largest"), F.col("image_idx"), mark.alias("m")))), lambda x: x["m"])).alias("q_marks"))
    return sections.join(marks, ["path", "section_idx"], "left").withColumn("content", F.concat("content", F.coalesce("q_marks", F.lit("")))).drop("q_marks")
