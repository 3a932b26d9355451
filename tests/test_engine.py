"""Parsers, store, engine and streaming, on files made here."""

import io
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmere import errors
from quillmere.config import Config
from quillmere.engine import Engine
from quillmere.operators import evaluation, experiments, rules
from quillmere.operators import store as S
from quillmere.sources import files, office, pdf
from quillmere.sources.providers import Deterministic
from quillmere.streaming import ingest


def raw_zip(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def word(paragraphs, table=None):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f'<w:p>{f"""<w:pPr><w:pStyle w:val="{style}"/></w:pPr>""" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>' for style, text in paragraphs)
    if table:
        body += "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in r) + "</w:tr>" for r in table) + "</w:tbl>"
    return raw_zip({"word/document.xml": f"<w:document {w}><w:body>{body}</w:body></w:document>"})


def portable(pages):
    parts = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (3 + 2 * i) for i in range(len(pages))) + b"] /Count %d >>" % len(pages)]
    for i, lines in enumerate(pages):
        data = zlib.compress(b"BT " + b" ".join(b"1 0 0 1 50 %d Tm (%s) Tj" % (700 - 20 * n, line.encode("cp1252")) for n, line in enumerate(lines)) + b" ET")
        parts += [b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (4 + 2 * i), b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(data) + data + b"\nendstream"]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, p) for i, p in enumerate(parts)) + b"%%EOF"


def test_word():
    found, _ = office.docx(word([("", "intro"), ("Heading1", "One"), ("", "a"), ("", "b"), ("Heading2", "Two"), ("", "c"), ("Heading1", "Empty")], [["x", "y"], ["1", "2"]]))
    assert [(s["heading"], s["content"], s["section_type"]) for s in found] == [("", "intro", "section"), ("One", "a\nb", "section"), ("Two", "c", "section"), ("Empty", "| x | y |\n| 1 | 2 |", "table")]


def test_slides_and_sheets():
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    slide = lambda t: f"<s {a}><a:p><a:r><a:t>{t}</a:t></a:r></a:p></s>"
    found, _ = office.pptx(raw_zip({"ppt/slides/slide10.xml": slide("ten"), "ppt/slides/slide2.xml": slide("two"), "ppt/slides/slide3.xml": slide("")}))
    assert [(s["heading"], s["content"]) for s in found] == [("Slide 2", "two"), ("Slide 10", "ten")]
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    book = {
        "xl/workbook.xml": f'<workbook xmlns:r="{r}"><sheets><sheet name="S" r:id="r1"/><sheet name="E" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<R><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></R>',
        "xl/sharedStrings.xml": "<sst><si><t>name</t></si></sst>",
        "xl/worksheets/sheet1.xml": '<w><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row></w>',
        "xl/worksheets/sheet2.xml": "<w/>",
    }
    found, _ = office.xlsx(raw_zip(book))
    assert [(s["heading"], s["content"], s["metadata"]) for s in found] == [("S", "| name |  | 5 |", {"sheet_name": "S", "row_count": "1"})]
    with pytest.raises(ValueError):
        office.xlsx(raw_zip({**book, "xl/worksheets/sheet1.xml": "<w/>"}))


def test_pdf_pages_and_headings():
    found, _ = pdf.read(portable([["1. Scope", "1.1 Parts", "the text (a) \\ here".replace("(", "\\(").replace(")", "\\)").replace(" \\ ", " ")], ["ALL CAPS", "more text"]]))
    assert [(s["heading"], s["content"], s["page_number"]) for s in found] == [("1. Scope", "", 1), ("1.1 Parts", "the text (a) here", 1), ("ALL CAPS", "more text", 2)]
    assert pdf.read(portable([[]]), "x.pdf")[0][0]["heading"] == "x.pdf"
    with pytest.raises(ValueError):
        pdf.read(b"no such thing")


def test_page_sections_merge_upwards():
    found = pdf.page_sections("CHAPTER\n1.1.1 Part one\nbody", 4)
    assert [(s["heading"], s["level"]) for s in found] == [("CHAPTER — 1.1.1 Part one", 1)]
    assert pdf.page_sections("just prose here, nothing else", 2)[0]["section_type"] == "section"


def test_image_sizes():
    png = pdf._png(40, 33, 0, [bytes(40)] * 33)
    assert office.image_size(png) == (40, 33) and office.image_size(b"GIF89a\x10\x00\x20\x00") == (16, 32) and office.image_size(b"?") == (0, 0)


def test_service_polls_until_done():
    replies = iter([{"id": 7}, {"status": "PENDING"}, {"status": "SUCCESS"}, {"markdown": "# A\ntext"}])

    class Reply(io.BytesIO):
        pass

    import json

    parser = files.service("http://none", "k", open_url=lambda request: Reply(json.dumps(next(replies)).encode()), sleep=lambda s: None)
    assert parser(b"x", "a.pdf")[0][0]["heading"] == "A"


def test_complexity(spark):
    rows = "| x | y | z |\n| 1 | 2 | 3 |\na     b\nc     d\ne     f"
    pages = spark.createDataFrame([("a", rows), ("a", "plain"), ("b", "plain text")], "path string, content string")
    got = rules.complexity(pages, "path", "content")
    assert {r["path"]: (r["score"], r["is_complex"]) for r in got.collect()} == {"a": (0.5, True), "b": (0.0, False)}
    wanted = spark.createDataFrame([("a", True), ("b", True)], "path string, expected boolean")
    assert experiments.detection_accuracy(got.join(wanted, "path"), "is_complex", "expected").first()["accuracy"] == 50.0


def test_experiments(spark, tmp_path):
    tests = spark.createDataFrame([(1, "What is the price?", "the price is 5 EUR\n\nmore", ["5 EUR"], "easy"), (2, "Who?", "nobody", ["somebody"], "easy")], "query_id bigint, question string, document string, facts array<string>, category string")
    out = experiments.full_context(tests, Deterministic())
    got = {r["query_id"]: (r["accuracy"], r["confidence"], r["passed"]) for r in out.collect()}
    assert got == {1: (1.0, 0.8, True), 2: (0.0, 0.8, False)}
    report = evaluation.report(out, ["accuracy"])
    assert "easy" in experiments.report_text(report, ["accuracy"]) and "1/2" in experiments.report_text(report, ["accuracy"])
    experiments.write_run(report, out, str(tmp_path / "run"), {"name": "x"})
    assert spark.read.json(str(tmp_path / "run" / "metadata")).first()["name"] == "x" and spark.read.json(str(tmp_path / "run" / "results")).count() == 2
    texts = spark.createDataFrame([(0, 1, "- a (term)")], "level int, community bigint, text string")
    assert experiments.summarise(texts, Deterministic()).first()["summary"]


def test_benchmark_source(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"tests": [{"query": "q1", "snippets": [{"file_path": "z.txt", "span": [0, 3], "answer": "abc"}]}, {"query": "q2", "snippets": [{"file_path": "a.txt", "span": [1, 9], "answer": "b"}]}]}')
    assert [r["query"] for r in files.benchmark_tests(spark, str(tmp_path / "t.json"), 1).collect()] == ["q2"]
    texts = spark.createDataFrame([("z.txt", bytearray("abcé".encode()))], "path string, content binary")
    spans = spark.createDataFrame([("z.txt", 0, 3), ("z.txt", 3, 5), ("z.txt", 1, 99), ("no", 0, 1)], "path string, start int, end int")
    assert [r["text"] for r in files.span_texts(spans, texts).orderBy("path", "start").collect()] == [None, "abc", None, "é"]


def test_upsert_keeps_and_overwrites(spark):
    old = spark.createDataFrame([(1, "a", "then"), (2, "b", "then")], "id int, v string, made string")
    new = spark.createDataFrame([(2, "", "now"), (3, "c", "now")], "id int, v string, made string")
    got = sorted(tuple(r) for r in S.upsert(old, new, ["id"], keep=("made",)).collect())
    assert got == [(1, "a", "then"), (2, "", "then"), (3, "c", "now")]
    rows = spark.createDataFrame([("x", "kept", 1), ("x", "", 2)], "k string, v string, n int")
    assert S.last_wins(rows, ["k"], "n").first()["v"] == "" and S.last_wins(rows, ["k"], "n", keep_blank=False).first()["v"] == "kept"


def test_numbers_are_dense(spark):
    rows = spark.range(500).select(F.concat(F.lit("k"), "id").alias("k"), (F.col("id") % 3 + 1).alias("w"))
    got = sorted((r["q_first"], r["w"]) for r in S.numbered(rows, "k", 10, "w").collect())
    assert got[0][0] == 10 and all(a[0] + a[1] == b[0] for a, b in zip(got, got[1:], strict=False))


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    (folder / "spec.docx").write_bytes(word([("Heading1", "3.2 Tensile Strength"), ("", "The tensile strength of the steel plate shall be 500 MPa when measured by ASTM D638, and the report shall name the laboratory, the date, the operator, and every deviation from ISO 9001 that was agreed upon before the test was made."), ("Heading1", "Other"), ("", "Nothing of note.")]))
    (folder / "contract.txt").write_text("The contract names a price of USD 2,500,000 and is governed by the law of Ruritania.")
    (folder / "broken.pdf").write_bytes(b"not a pdf")
    e = Engine(spark, str(tmp_path_factory.mktemp("store")), Config(embedding_dim=64))
    e.folder = folder
    return e


def test_engine_round_trip(engine, spark):
    first = {r["path"].rpartition("/")[2]: r["status"] for r in engine.ingest(str(engine.folder)).collect()}
    assert first == {"spec.docx": "ready", "contract.txt": "ready", "broken.pdf": "error"}
    stats = {r["table_name"]: r["n"] for r in engine.store.stats().collect()}
    assert stats["documents"] == 3 and stats["chunks"] == stats["embeddings"] == 6 and stats["entities"] >= 2
    chunks = engine.store.table("chunks").collect()
    ids = {c["id"] for c in chunks}
    assert all(c["parent_chunk_id"] is None or c["parent_chunk_id"] in ids for c in chunks) and len(ids) == 6
    questions = spark.createDataFrame([(1, "What tensile strength does ASTM D638 give?"), (2, "Which law governs the contract price?")], "query_id bigint, question string")
    out = {r["query_id"]: r for r in engine.query(questions, structured=True).collect()}
    assert "Tensile Strength" in out[1]["answer"] and "Ruritania" in out[2]["answer"] and out[1]["confidence"] > 0
    assert out[1]["sources"][0]["filename"] == "spec.docx" and any("500 MPa" in s["content"] for s in out[1]["sources"]) and any("graph" in s["methods"] for s in out[1]["sources"])
    assert engine.store.table("query_log").count() == 2
    again = {r["path"].rpartition("/")[2]: r["status"] for r in engine.ingest(str(engine.folder)).collect()}
    assert again == {"spec.docx": "unchanged", "contract.txt": "unchanged", "broken.pdf": "error"}
    (engine.folder / "contract.txt").write_text("The contract was torn up.")
    changed = {r["path"].rpartition("/")[2]: r["status"] for r in engine.update_all().collect()}
    assert changed["contract.txt"] == "ready" and changed["spec.docx"] == "unchanged"
    assert engine.store.table("chunks").where("content like '%torn up%'").count() == 2 and engine.store.table("chunks").count() == 6
    path = next(r["path"] for r in engine.documents().collect() if r["filename"] == "spec.docx")
    engine.delete(path)
    left = {r["table_name"]: r["n"] for r in engine.store.stats().collect()}
    assert left["documents"] == 2 and left["chunks"] == left["embeddings"] == 2 and left["entities"] == stats["entities"]
    with pytest.raises(errors.NotFound):
        engine.delete(path)


def test_migrations_run_once(engine):
    assert engine.store.version() == len(S.MIGRATIONS) and engine.store.migrate() == []


def test_stream_ingests_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one text")
    e = Engine(spark, str(tmp_path / "store"), Config(embedding_dim=8, skip_graph=True))
    for _ in range(2):
        ingest.ingest_stream(e, str(tmp_path / "in"), str(tmp_path / "ck")).awaitTermination()
    assert e.store.table("documents").count() == 1 and e.store.table("chunks").count() == 2
    e.close()
    with pytest.raises(errors.Closed):
        e.documents()


def test_windowed_counts(spark, sf):
    out = ingest.windowed_counts(spark.read.parquet(f"{sf}/events.parquet"))
    assert out.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


def test_config_bounds():
    assert Config().bounded(500, 11) == (20, 3) and Config().bounded(7, 2) == (7, 2)
    with pytest.raises(errors.BadConfig):
        Config(chunk_tokens=0)


def test_vectors_are_unit():
    v = np.array(Deterministic(32).embed(["a b c"])[0])
    assert abs(np.linalg.norm(v) - 1) < 1e-9
