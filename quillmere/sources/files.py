"""Files to sections and images: a registry of parsers, run over ``binaryFile`` rows in Arrow batches."""

from __future__ import annotations

import hashlib
import json
import posixpath
import re
import time
import urllib.request
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.sources import office, pdf

Parser = Callable[[bytes, str], tuple[list[dict], list[dict]]]
SECTIONS = "path string, section_idx int, heading string, content string, level int, page_number int, section_type string, metadata map<string,string>, error string"
IMAGES = "path string, section_idx int, page_number int, mime string, width int, height int, data binary, error string"


def text(data: bytes, name: str = "") -> tuple[list[dict], list[dict]]:
    """A whole file as one paragraph under its name; an empty one has no section."""
    content = data.decode("utf-8", "replace")
    return ([office.section(name, content, 1, 0, "paragraph")] if content else []), []


def legacy(data: bytes, name: str = "") -> tuple[list[dict], list[dict]]:
    raise ValueError("old binary formats are not read; save the file in the newer one")


class Registry:
    """Format -> parser; a registered one overrides."""

    def __init__(self):
        self.parsers: dict[str, Parser] = {"txt": text, "docx": office.docx, "pptx": office.pptx, "xlsx": office.xlsx, "xls": office.xlsx, "pdf": pdf.read, "doc": legacy, "ppt": legacy}

    def register(self, kind: str, parser: Parser) -> None:
        self.parsers[kind.lower()] = parser

    def get(self, kind: str) -> Parser:
        if kind.lower() not in self.parsers:
            raise ValueError(f"no parser for {kind!r}")
        return self.parsers[kind.lower()]

    def remote(self, parser: Parser) -> None:
        """A conversion service in place of the own parsers."""
        for kind in ("pdf", "docx", "xlsx", "pptx"):
            self.register(kind, parser)


def markdown(text_: str) -> list[dict]:
    """Sections of a Markdown text by its headings."""
    out, heading, level, lines = [], "", 1, []
    for line in [*text_.split("\n"), None]:
        m = re.match(r"(#{1,6})\s+(.*)", line) if line is not None else None
        if m or line is None:
            content = "\n".join(lines).strip()
            if content or heading:
                out.append(office.section(heading, content, level, 0, pdf.section_type(heading, content)))
            if m:
                heading, level, lines = m.group(2).strip(), len(m.group(1)), []
        else:
            lines.append(line)
    return out


def service(base_url: str, api_key: str, tries: int = 60, wait: float = 5.0, open_url=urllib.request.urlopen, sleep=time.sleep) -> Parser:
    """A parser that uploads to a conversion service and polls for Markdown, at most ``tries`` times."""

    def call(path: str, body: bytes | None = None, kind: str = "application/json") -> dict:
        request = urllib.request.Request(base_url.rstrip("/") + path, body, {"Authorization": f"Bearer {api_key}", "Content-Type": kind})
        with open_url(request) as r:
            return json.load(r)

    def parser(data: bytes, name: str = "") -> tuple[list[dict], list[dict]]:
        edge = hashlib.sha256(data).hexdigest()
        body = f'--{edge}\r\nContent-Disposition: form-data; name="file"; filename="{name}"\r\n\r\n'.encode() + data + f"\r\n--{edge}--\r\n".encode()
        job = call("/upload", body, f"multipart/form-data; boundary={edge}")["id"]
        for _ in range(tries):
            status = call(f"/job/{job}")["status"]
            if status == "SUCCESS":
                return markdown(call(f"/job/{job}/result/markdown")["markdown"]), []
            if status in ("ERROR", "CANCELED"):
                raise ValueError(f"conversion ended as {status}")
            sleep(wait)
        raise TimeoutError("the conversion took too long")

    return parser


def vision(describe: Callable[[bytes, str], str]) -> Parser:
    """A parser that asks a vision model for a whole file; its sections stand on page 1."""

    def parser(data: bytes, name: str = "") -> tuple[list[dict], list[dict]]:
        return [{**s, "page_number": 1} for s in markdown(describe(data, name))], []

    return parser


def walk(spark: SparkSession, folder: str, kinds: tuple[str, ...] = ("txt", "pdf", "docx"), used: DataFrame | None = None) -> DataFrame:
    """(path, content, content_hash, format) of the files below a folder; with ``used`` (path, ending of the full path) only those."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(kinds) + "}").load(folder)
    if used is not None:
        names = files.select("path")
        wanted = used.select(F.col("path").alias("q_used")).distinct()
        base = names.withColumn("q_base", F.substring_index("path", "/", -1)).join(wanted.withColumn("q_base", F.substring_index("q_used", "/", -1)), "q_base")
        files = files.join(base.where(F.endswith("path", F.col("q_used"))).select("path").distinct(), "path", "left_semi")
    return hashed(files)


def hashed(files: DataFrame) -> DataFrame:
    return files.select("path", "content", F.sha2("content", 256).alias("content_hash"), F.lower(F.substring_index("path", ".", -1)).alias("format"))


def _rows(files: DataFrame, registry: Registry, schema: str, which: int) -> DataFrame:
    parsers = dict(registry.parsers)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                kind = path.rpartition(".")[2].lower()
                try:
                    if kind not in parsers:
                        raise ValueError(f"no parser for {kind!r}")
                    found = parsers[kind](data, posixpath.basename(path))[which]
                    rows = [{"section_idx": i, **r, "path": path, "error": None} for i, r in enumerate(found)]
                except Exception as e:  # noqa: BLE001 - one broken file must not end the job; its row says why
                    rows = [{"path": path, "error": f"{type(e).__name__}: {e}"}]
                if rows:
                    yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], kinds)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema))
    return files.select("path", "content").mapInArrow(run, schema)


def sections(files: DataFrame, registry: Registry | None = None) -> DataFrame:
    """The sections of every file; a file that can't be parsed is one row with an error. ``files``: path, content."""
    return _rows(files, registry or Registry(), SECTIONS, 0)


def images(files: DataFrame, registry: Registry | None = None) -> DataFrame:
    return _rows(files, registry or Registry(), IMAGES, 1)


BENCHMARK = "tests array<struct<query:string, snippets:array<struct<file_path:string, span:array<int>, answer:string>>, tags:array<string>>>"


def benchmark_tests(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(test_id, query, snippets, tags) of a JSON file of retrieval tests; ``most`` keeps the first by the first snippet's file, then by place."""
    from pyspark.sql import Window as W

    rows = spark.read.schema(BENCHMARK).json(path, multiLine=True).select(F.posexplode("tests").alias("test_id", "t")).select("test_id", "t.*")
    if most is None:
        return rows
    order = F.row_number().over(W.orderBy(F.coalesce(F.try_element_at("snippets", F.lit(1))["file_path"], F.lit("")), "test_id"))
    return rows.withColumn("n", order).where(F.col("n") <= most).drop("n")


def span_texts(spans: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``text``: bytes [start, end) of the file of a span, null where they aren't within it. ``spans``: path, start, end; ``files``: path, content."""
    inside = (F.col("start") >= 0) & (F.col("end") <= F.octet_length("content")) & (F.col("start") < F.col("end"))
    cut = F.decode(F.substring("content", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")), "utf-8")
    return spans.join(files.select("path", "content"), "path", "left").withColumn("text", F.when(inside, cut)).drop("content")
