"""Rules of documents: headings, section types, running headers, requirements, clauses, definitions, tables, references."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmere.functions import text as T
from quillmere.functions.batches import lean, settle

HEADING_PREFIXES = sorted({f"{w} " for w in "anexo annexe article artigo capitulo capítulo chapitre chapter part partie seccion secao section sección seção".split()})
FIGURE_PREFIXES = sorted("cuadro figura figure graphique gráfico quadro tabela tabla tableau".split())
REQUIREMENT_WORDS = sorted(["especificación", "must", "requirement", "requisito", "shall"])
MEANS = '(?i)^["“]([^"”]+)["”]\\s+(?:shall\\s+mean|means)\\b'
COLON = "^([A-Z][A-Za-z\\s]+):\\s+.+"
DEFINES = '(?i)^(?:"[^"]+"\\s+(?:shall\\s+mean|means)|\\S+.*?:\\s+\\S)'
HEADINGS = ["^([0-9]+\\.)+([0-9]+)?\\s+\\S", "^[A-Z][A-Z\\s]{4,}$", "^#{1,6}\\s+\\S", "(?i)^(annex|appendix|exhibit|schedule)\\s+[0-9A-Z]", "(?i)^article\\s+[0-9CDILMVX]+"]
CROSS_REFERENCES = {
    **{k: rf"(?i)\b{k}\s+(\d+(?:\.\d+)*)" for k in ("clause", "section")},
    "article": r"(?i)\barticle\s+(\d+|[CDILMVX]+)",
    **{k: rf"(?i)\b{k}\s+([0-9A-Z]+)" for k in ("annex", "appendix", "schedule")},
    "ref": r"\((?:ref\.?|see)\s+(\d+(?:\.\d+)*)\)",
}
_DASHED = r"\d[\d-]+"
STANDARDS = {
    "ISO": rf"\bISO(?:/IEC)?\s+{_DASHED}(?::\d{{4}})?",
    "IEC": rf"\bIEC\s+{_DASHED}(?::\d{{4}})?",
    "ASTM": r"\bASTM\s+[A-Z]\d+(?:-\d+)?(?::\d{4})?",
    "IEEE": r"\bIEEE\s+(?:Std\s+)?\d[\d.]+",
    "ANSI": r"\bANSI(?:/\w+)?\s+[A-Z]?[\d.]+",
    **{b: rf"\b{b}\s+(?:EN\s+)?{_DASHED}" for b in ("BS", "DIN")},
    "EN": rf"\bEN\s+{_DASHED}",
    "NFPA": r"\bNFPA\s+\d+",
    **{b: rf"\b{b}\s+[A-Z][\d.]+" for b in ("ASME", "AWS")},
    "MIL": r"\bMIL-STD-\d+[A-Z]?",
    "SAE": r"\bSAE\s+[A-Z]+\s*\d+",
    "API": r"\bAPI\s+(?:Std\s+)?\d+",
}


def _dots(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit("."), F.lit("")))


def is_heading(line: Column) -> Column:
    """All capitals and short, or a number with a dot, or a heading word, or a figure word with a number."""
    size, low = F.octet_length(line), F.lower(line)
    named = F.lit(False)
    for p in HEADING_PREFIXES:
        named = named | F.startswith(low, F.lit(p))
    numbered = line.rlike("^[0-9]") & F.contains(F.left(line, F.lit(10)), F.lit("."))
    figure = low.rlike(f"^({'|'.join(FIGURE_PREFIXES)}) [0-9]")
    return ((size < 100) & (size > 2) & (line == F.upper(line))) | ((size < 120) & (size > 0) & (numbered | named | figure))


def heading_level(line: Column) -> Column:
    """Dots of the first word; without any, 1 for capitals and 2 for the rest."""
    dots = _dots(F.element_at(F.split(line, " "), 1))
    return F.when(dots > 0, dots).when(line == F.upper(line), 1).otherwise(2)


def section_type(heading: Column, content: Column) -> Column:
    """The first that holds: definition, requirement, table, annex, section."""
    h, c = F.lower(heading), F.lower(content)
    count = lambda mark: F.length(content) - F.length(F.translate(content, mark, ""))
    return (
        F.when(T.any_of(h, ["definition", "definición", "glosario", "glossary"]) | T.any_of(c, ["definition", "definición"]), "definition")
        .when(T.any_of(h, REQUIREMENT_WORDS) | T.any_of(c, REQUIREMENT_WORDS), "requirement")
        .when(T.any_of(h, ["table", "tabla"]) | (count("\t") > 3) | (count("|") > 3), "table")
        .when(T.any_of(h, ["anexo", "annex"]), "annex")
        .otherwise("section")
    )


def repair_running_headers(sections: DataFrame, file: str, page: str, order: str, normalise: bool = True) -> DataFrame:
    """Headings that stand on at least a quarter of a file's pages (three at least) give way to the last real heading before them; adds ``running``.

    Distinct pages are counted in aggregations; the carry-forward is one running window a file.
    """
    key = F.regexp_replace(T.trimmed(F.col("heading")), "(?:\\s|[^\\x00-\\x7F])+$", "") if normalise else F.col("heading")
    keyed = sections.withColumn("q_key", key)
    pages = keyed.groupBy(file).agg(F.countDistinct(page).alias("q_total"))
    seen = keyed.groupBy(file, "q_key").agg(F.countDistinct(page).alias("q_on"))
    marked = keyed.join(seen, [file, "q_key"]).join(pages, file)
    marked = marked.withColumn("running", (F.col("q_key") != "") & (F.col("q_on") >= F.greatest(F.lit(3), F.floor(F.col("q_total") / 4))))
    before = W.partitionBy(file).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    real = F.when(~F.col("running") & (F.col("heading") != ""), F.struct("heading", "level"))
    last = F.last(real, ignorenulls=True).over(before)
    fixed = marked.withColumn("q_last", last)
    for c in ("heading", "level"):
        fixed = fixed.withColumn(f"q_{c}", F.when(F.col("running"), F.coalesce(F.col(f"q_last.{c}"), F.col(c))).otherwise(F.col(c)))
    return fixed.drop("heading", "level", "q_key", "q_on", "q_total", "q_last").withColumnsRenamed({"q_heading": "heading", "q_level": "level"})


def _lines(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key), F.posexplode(F.split(text, "\n")).alias("n", "line")).withColumn("n", F.col("n").cast("bigint"))


def requirements(df: DataFrame, key: str, text: str) -> DataFrame:
    """Lines with a normative keyword: the first keyword and its level."""
    pattern = r"(?i)\b(shall\s+not|must\s+not|should\s+not|shall|must|should|required|recommended|may|optional)\b"
    found = _lines(df, key, text).select(key, F.col("n").alias("line_number"), T.trimmed(F.col("line")).alias("line")).withColumn("keyword", F.upper(F.regexp_extract("line", pattern, 1))).where("keyword <> ''")
    level = F.when(F.col("keyword").isin("SHOULD", "SHOULD NOT", "RECOMMENDED"), "recommended").when(F.col("keyword").isin("MAY", "OPTIONAL"), "optional").otherwise("mandatory")
    return found.withColumn("level", level)


def is_separator(line: Column) -> Column:
    return F.regexp_replace(T.trimmed(line), "[| :]", "").rlike("^-{3,}$")


def tables(df: DataFrame, key: str, text: str) -> DataFrame:
    """Runs of at least two table lines: (key, start_line, end_line, has_headers, content)."""
    clean = T.trimmed(F.col("line"))
    is_table = (clean != "") & (F.contains(F.col("line"), F.lit("|")) | (F.length(clean) - F.length(F.translate(clean, "\t", "")) >= 2) | is_separator(F.col("line")))
    rows = _lines(df, key, text).where(is_table).withColumn("island", F.col("n") - F.row_number().over(W.partitionBy(key).orderBy("n")))
    return rows.groupBy(key, "island").agg(F.min("n").alias("start_line"), (F.max("n") + 1).alias("end_line"), F.bool_or(is_separator(F.col("line"))).alias("has_headers"), F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"])).alias("content"), F.count(F.lit(1)).alias("q_n")).where("q_n >= 2").drop("island", "q_n")


def table_fragments(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start_line, is_table, content): tables whole, and the prose between them, in order."""
    clean = T.trimmed(F.col("line"))
    is_table = (clean != "") & (F.contains(F.col("line"), F.lit("|")) | (F.length(clean) - F.length(F.translate(clean, "\t", "")) >= 2) | is_separator(F.col("line")))
    order = W.partitionBy(key).orderBy("n")
    rows = _lines(df, key, text).withColumn("t", is_table)
    runs = rows.withColumn("run", F.sum((F.col("t") != F.coalesce(F.lag("t").over(order), ~F.col("t"))).cast("int")).over(order))
    sized = runs.withColumn("size", F.count(F.lit(1)).over(W.partitionBy(key, "run"))).withColumn("t", F.col("t") & (F.col("size") >= 2))
    again = sized.withColumn("run", F.sum((F.col("t") != F.coalesce(F.lag("t").over(order), ~F.col("t"))).cast("int")).over(order))
    made = again.groupBy(key, "run").agg(F.min("n").alias("start_line"), F.first("t").alias("is_table"), F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"])).alias("content"))
    return made.select(key, "start_line", "is_table", F.when(F.col("is_table"), F.col("content")).otherwise(T.trimmed(F.col("content"))).alias("content")).where("content <> ''")


def clauses(df: DataFrame, key: str, text: str) -> DataFrame:
    """Lines that begin with a clause number: (key, line_number, clause, depth, offset_bytes)."""
    before = W.partitionBy(key).orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    rows = _lines(df, key, text).select(key, F.col("n").alias("line_number"), "n", F.regexp_extract(T.trimmed(F.col("line")), r"^(\d+(?:\.\d+)+)\s", 1).alias("clause"), (F.octet_length("line") + 1).alias("bytes"))
    rows = rows.withColumn("offset_bytes", F.coalesce(F.sum("bytes").over(before), F.lit(0)).cast("bigint")).where("clause <> ''")
    return rows.select(key, "line_number", "clause", (_dots(F.col("clause")) + 1).cast("bigint").alias("depth"), "offset_bytes")


def split_by_clauses(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, part, content): the preamble, and every clause with what follows it."""
    rows = _lines(df, key, text).withColumn("begins", T.trimmed(F.col("line")).rlike(r"^\d+(\.\d+)+\s"))
    parts = rows.withColumn("part", F.sum(F.col("begins").cast("int")).over(W.partitionBy(key).orderBy("n")))
    made = parts.groupBy(key, "part").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"])).alias("content"))
    return made.select(key, "part", T.trimmed(F.col("content")).alias("content")).where("content <> ''")


def definitions(df: DataFrame, key: str, text: str) -> DataFrame:
    """Lines that define a term: (key, line_number, term, definition)."""
    rows = _lines(df, key, text).select(key, F.col("n").alias("line_number"), T.trimmed(F.col("line")).alias("definition"))
    line = F.col("definition")
    return rows.where(line.rlike(MEANS) | line.rlike(COLON)).select(key, "line_number", "definition", F.when(line.rlike(MEANS), F.regexp_extract(line, MEANS, 1)).otherwise(T.trimmed(F.regexp_extract(line, COLON, 1))).alias("term"))


def reference_counts(df: DataFrame, key: str, text: str, patterns: dict[str, str] = CROSS_REFERENCES) -> DataFrame:
    """(key, kind, target, mentions): the text is read once for all patterns."""
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(text, F.lit(p), F.lit(1)).alias("targets")) for k, p in patterns.items()])
    rows = df.select(key, F.explode(found).alias("f")).select(key, F.col("f.kind").alias("kind"), F.explode("f.targets").alias("target"))
    return rows.groupBy(key, "kind", "target").agg(F.count(F.lit(1)).alias("mentions"))


def find_references(text: str) -> list[tuple[str, str, str, int]]:
    """(kind, match, target, byte offset) of cross-references and standards, pattern after pattern; overlaps stay."""
    at = (lambda i: i) if text.isascii() else (lambda i: len(text[:i].encode()))
    out = [(k, m.group(0), m.group(1), at(m.start())) for k, p in _COMPILED[0] for m in p.finditer(text)]
    return out + [(f"standard:{k}", m.group(0), m.group(0), at(m.start())) for k, p in _COMPILED[1] for m in p.finditer(text)]


_COMPILED = [[(k, re.compile(p, re.ASCII)) for k, p in table.items()] for table in (CROSS_REFERENCES, STANDARDS)]


def references(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, match, target, offset) with byte offsets; Arrow batches, as the engine has no find-all with offsets."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = [(i, *r) for i, t in enumerate(batch.column(1).to_pylist()) if t for r in find_references(t)]
            at = pa.array([r[0] for r in rows], pa.int64())
            cols = [pa.array([r[j] for r in rows], t) for j, t in ((1, pa.string()), (2, pa.string()), (3, pa.string()), (4, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *cols], names=[key, "kind", "match", "target", "offset"])

    settle(df.sparkSession)
    return df.select(key, text).mapInArrow(lean(run), f"{key} {kind}, kind string, match string, target string, offset bigint")


def content_type(text: Column) -> Column:
    """The first that holds: table, definition, requirement, section, paragraph."""
    def of(body: Column, lines: Column) -> Column:
        n = F.size(lines)
        # most texts have no such mark at all, and then no line is looked at
        count = lambda f, *marks: F.when(T.any_of(body, list(marks)), F.size(F.filter(lines, lambda x: T.any_of(x, list(marks)) & f(x)))).otherwise(0)
        tabs = count(lambda x: F.length(x) - F.length(F.translate(x, "\t", "")) >= 2, "\t")
        ruled = count(lambda x: T.trimmed(x).rlike("^(-{4,}|={4,})$"), "----", "====")
        table = ((n >= 3) & (count(lambda x: F.lit(True), "|") >= F.floor(n / 2))) | (tabs >= 2) | (ruled > 0)
        defined = count(lambda x: T.trimmed(x).rlike(DEFINES), ":", '"') >= F.when(n <= 3, 1).otherwise(2)
        titled = lambda head: reduce(or_, [head.rlike(p) for p in HEADINGS])
        head = T.trimmed(F.substring_index(body, "\n", 1))  # the body is trimmed, so its first line isn't blank
        return F.when(body == "", "paragraph").when(table, "table").when(defined, "definition").when(T.any_of(F.upper(body), ["SHALL", "MUST", "REQUIRED"]), "requirement").when(T.let(head, titled), "section").otherwise("paragraph")

    return T.let(T.trimmed(text), lambda body: T.let(F.split(body, "\n"), lambda lines: of(body, lines)))


def numbering(line: Column) -> Column:
    """A hierarchical number at the start of a line, before a final dot."""
    return F.nullif(F.regexp_extract(T.trimmed(line), r"^(\d+(?:\.\d+)*)\.\s", 1), F.lit(""))


def depth(number: Column) -> Column:
    return F.when(F.coalesce(number, F.lit("")) == "", 0).otherwise(_dots(number) + 1)


def complexity(pages: DataFrame, file: str, text: str) -> DataFrame:
    """(file, has_tables, multi_column, score, is_complex): tables weigh .3 and columns .2; images and fonts, which are not detected, the rest."""
    tabs = (F.length(text) - F.length(F.translate(text, "\t", "")) > 5) | (F.length(text) - F.length(F.translate(text, "|", "")) > 5)
    wide = F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S {4,}\S")))
    columns = wide > F.size(F.split(text, "\n")) / 3
    flags = pages.groupBy(file).agg(F.bool_or(tabs).alias("has_tables"), F.bool_or(columns).alias("multi_column"))
    score = F.round(F.col("has_tables").cast("double") * 0.3 + F.col("multi_column").cast("double") * 0.2, 6)
    return flags.withColumn("score", score).withColumn("is_complex", F.col("score") >= 0.5)
