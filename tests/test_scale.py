"""What kept queries from larger tables, and odd inputs that larger tables have."""

import random

import duckdb
import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from quillmere.operators import evaluation, fulltext, graph, reasoning, retrieval, rules, scoring
from quillmere.plans import catalog
from quillmere.sources.providers import Deterministic


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("text", ["", "\nbody", " \t\n" + "word " * 60, "head\nbody  ", "é" * 150, "a" + "é" * 120, "ab" + "€" * 90, "x" + "\U0001f600" * 70, "é" * 99 + " é" * 40, "a" * 199 + " b", "a" * 200 + " b"])
def test_parent_content_of_odd_texts(spark, tmp_path, text):
    spark.createDataFrame([(1, text)], "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert rows_of(catalog.QUERIES["parent_content"](spark, str(tmp_path)).toArrow()) == rows_of(con.execute(catalog.SQL["parent_content"]).to_arrow_table())


def test_content_type_cuts_a_text_once(spark):
    texts = ["a|b\nc|d\ne|f", "x\ty\tz\n1\t2\t3", "one\n  ====  \ntwo", "Term: a thing", '"Term" shall mean it', "a b\nc d\ne: f\ng h", "it must be", "# Title\ntext", "text", " \n ", "note -- ----", "3. a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i bigint, text string").select("i", rules.content_type(F.col("text")).alias("kind"))
    assert plan_of(df).count("split(") == 1
    assert [r["kind"] for r in df.orderBy("i").collect()] == ["table", "table", "table", "definition", "definition", "paragraph", "requirement", "section", "paragraph", "paragraph", "paragraph", "section"]


def test_cues_are_looked_for_once(spark):
    chunks = spark.createDataFrame([(1, "ISO 9001 supersedes ISO 9000 in all plants. " + "word " * 30)], "chunk_id bigint, content string")
    edges = graph.extract(chunks)[1]
    assert plan_of(edges).count("Generate explode(here") == 2
    assert {(r["source"], r["relation_type"], r["target"]) for r in edges.collect()} >= {("iso 9001", "supersedes", "iso 9000")}


def test_postings_are_counted_where_a_text_is(spark):
    rows = [(1, "a b² a"), (2, "Ⅷ ½ ́x"), (1, "b a"), (None, "c"), (3, None), (None, "c c"), (4, "")]
    got = retrieval.postings(spark.createDataFrame(rows, "chunk_id bigint, content string"))
    assert "Aggregate" not in plan_of(got)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "a", 3), (1, "b", 2), (2, "x", 1), (None, "c", 3)], key=repr)


def test_scores_add_up_without_joins(spark, monkeypatch):
    rng = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "eps", "ünder", "the"]
    chunks = spark.createDataFrame([(rng.randrange(70), " ".join(rng.choice(words) for _ in range(rng.randrange(9)))) for _ in range(90)] + [(100, None), (101, "")], "chunk_id bigint, content string").repartition(3)
    asked = spark.createDataFrame([(q, " ".join(rng.sample(words, 3))) for q in range(5)] + [(9, None), (10, "the")], "query_id bigint, question string")
    for top in (None, 4):
        quick = retrieval.bm25(chunks, asked, top=top)
        assert "Join" not in plan_of(quick)
        with monkeypatch.context() as m:
            m.setattr(scoring, "BOUND", 0)
            plain = retrieval.bm25(chunks, asked, top=top)
            assert "Join" in plan_of(plain)
            assert quick.dtypes == plain.dtypes and {tuple(r) for r in quick.collect()} == {tuple(r) for r in plain.collect()}


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_nearest_of_odd_vectors(spark, metric):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(700, 6)).round(2)
    v[100:160], v[5], v[6], v[7:9] = v[0], 0, 1e12, v[0] * 1e-9
    v[9, 2] = np.nan
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(3, [0.5] * 6), (900, None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = retrieval.nearest(df, df.withColumnRenamed("vec_id", "query_id"), 3, metric, block=200, exclude_self=True)
    want = set()
    ids, all_ = np.array([i for i, x in rows if x]), np.array([x for _, x in rows if x])
    for q in range(len(ids)):
        x = np.round(retrieval._distances(metric, np.repeat(all_[q : q + 1], len(ids), 0), all_), 6) + 0.0
        ok = np.isfinite(x) & (ids != ids[q])
        want |= {(int(ids[q]), int(ids[j]), float(x[j])) for j in np.flatnonzero(ok)[np.lexsort((ids[ok], x[ok]))][:3]} if ids[q] != 3 else set()
    assert {(r["query_id"], r["vec_id"], r["distance"]) for r in got.where("query_id <> 3").collect()} == want


def test_few_pairs_are_compared_exactly():
    rng = np.random.default_rng(1)
    q, d = rng.normal(size=(50, 16)), rng.normal(size=(20_000, 16))
    rows, _ = retrieval._candidates(*retrieval._searched("l2", q, d), 10)
    assert 10 <= np.bincount(rows).min() and np.bincount(rows).max() <= 15


def test_relationships_are_made_once(spark, tmp_path):
    def seen(batches, folder=str(tmp_path)):
        import uuid

        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        yield from batches

    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(8)], "source_entity_id bigint, target_entity_id bigint, weight double").coalesce(1).mapInArrow(seen, "source_entity_id bigint, target_entity_id bigint, weight double")
    assert graph.communities(spark.range(12), edges).where("level = 0").count() == 4
    assert len(list(tmp_path.iterdir())) == 1


ANSWERS = "query_id bigint, question string, answer string, facts array<string>, sources array<struct<filename string, heading string, content string, page_number int, chunk_id bigint, chunk_type string>>"


def source(content, heading="A heading"):
    return ("a.pdf", heading, content, 1, 7, "paragraph")


def test_snippets_cut_sentences_in_batches(spark):
    texts = ["One two. Pumps need pressure! Why?", "Nothing here.", "", "Pressure of pumps." + "x" * 300 + " pressure. End pumps", "a pumps.b pressure² ok. c"]
    df = spark.createDataFrame([(texts, ["pumps", "pressure"]), (None, ["x"])], "c array<string>, w array<string>").select(evaluation.snippets(F.col("c"), F.col("w")).alias("s"))
    assert "transform" not in plan_of(df)
    assert [r["s"] for r in df.collect()] == [["Pumps need pressure!", "", "", "Pressure of pumps." + "x" * 300 + " pressure.", "a pumps.b pressure² ok."], None]


def test_stems_are_made_once(spark, monkeypatch):
    rng = random.Random(3)
    words = ["pumps", "pumping", "pressure", "valve", "Übung", "the", "rotating", "rotate"]
    chunks = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.randrange(12)))) for i in range(80)] + [(100, None), (101, "")], "chunk_id bigint, content string").repartition(3)
    asked = spark.createDataFrame([(q, " ".join(rng.sample(words, rng.randrange(1, 4)))) for q in range(8)] + [(9, None), (10, "the")], "query_id bigint, question string")
    groups = spark.createDataFrame([(0, "valves pressure"), (1, "Uebung"), (2, "pumps"), (2, "rotates"), (3, "")], "query_id bigint, term string")
    for more in (None, groups):
        quick = fulltext.search(chunks, asked, groups=more)
        assert "_stems" not in plan_of(quick)
        kept = fulltext.search(None, asked, indexed=fulltext.index(chunks), groups=more)
        with monkeypatch.context() as m:
            m.setattr(scoring, "BOUND", -1)
            plain = {tuple(r) for r in fulltext.search(chunks, asked, groups=more).collect()}
        assert {tuple(r) for r in quick.collect()} == plain == {tuple(r) for r in kept.collect()} and plain


def test_texts_are_found_in_one_pass(spark, monkeypatch):
    rng = random.Random(4)
    words = ["alpha", "beta", "gam-ma", "é", "x1²", "--", "(", "delta.", "a"]
    chunks = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.randrange(12)))) for i in range(60)] + [(99, None)], "chunk_id bigint, content string")
    wanted = spark.createDataFrame([(f,) for f in {" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(60)}], "low string")
    quick = evaluation.holding(chunks, wanted)
    assert "Join" not in plan_of(quick)
    with monkeypatch.context() as m:
        m.setattr(evaluation, "HELD", (0, 0))
        plain = {tuple(r) for r in evaluation.holding(chunks, wanted).collect()}
    assert {tuple(r) for r in quick.collect()} == plain and plain


def test_words_are_looked_up_in_batches(spark):
    rows = [(1, "Which pump?", "The pump, at 17.5 bars, fails 17.5 quicklyish.", ["pump"], [source("A PUMP at 17.5 bar"), source("none", "")]), (2, "", "no", [], [source("x")]), (3, "what pump", "pumps", ["a"], []), (4, "pump pump valve", "İpump valve ΑΣ", ["x"], [source("valve ας"), source(None)])]
    df = spark.createDataFrame(rows, ANSWERS)
    made = evaluation.score(df)
    assert "_words_in" in plan_of(made) and "_counts_in" in plan_of(made)
    a, q, s = F.col("answer"), F.col("question"), F.col("sources")
    plain = df.select("query_id", evaluation.relevance(q, s).alias("relevance"), evaluation.claim_grounding(a, s).alias("claim_grounding"), evaluation.hallucination(a, s).alias("hallucination"))
    assert sorted(map(tuple, made.select(*plain.columns).collect())) == sorted(map(tuple, plain.collect()))


@pytest.mark.parametrize("build", [lambda df: reasoning.ask(df, "text", "reply", Deterministic()), lambda df: rules.references(df, "doc_id", "text")], ids=["ask", "references"])
def test_batches_are_bounded_in_bytes(spark, build):
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 30))
    made = build(spark.createDataFrame([(1, "see clause 4.2 and é clause 5")], "doc_id bigint, text string"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
    assert made.count() > 0


def test_names_that_differ_in_numbers_only(spark):
    entities = spark.createDataFrame([(i, f"supplier#{i:09}") for i in range(400)], "id bigint, name string")
    terms = spark.createDataFrame([(i, f"supplier#{i:09}"[:16]) for i in range(400)] + [(1000, "plier#0"), (1001, "#0000003")], "query_id bigint, term string")
    found = graph.fuzzy_entities(entities, terms, limit=1000)
    want = {(q, i) for q, t in map(tuple, terms.collect()) for i in range(400) if t in f"supplier#{i:09}"}
    assert {(r["query_id"], r["id"]) for r in found.collect()} == want
    # of grams of four characters each term of sixteen would share its rarest with all names
    assert max(graph.GRAMS) == 16


def test_chunks_aren_t_looked_up_again(spark):
    rng = random.Random(9)
    links = [(rng.randrange(8), rng.randrange(60)) for _ in range(500)]
    for edges in ([(a, a, rng.random()) for a in range(8)], [(0, 1, 0.9), (2, 2, 0.1), (3, 3, None)], [(3, 3, None)]):
        frames = (spark.createDataFrame([(q, rng.randrange(8)) for q in range(5) for _ in range(3)], "query_id bigint, id bigint"), spark.createDataFrame(links, "entity_id bigint, chunk_id bigint"), spark.createDataFrame(edges, "source_entity_id bigint, target_entity_id bigint, weight double"))
        quick = graph.search_chunks(*frames, top=6)
        assert {tuple(r) for r in quick.collect()} == {tuple(r) for r in graph.search_chunks(*frames).where("rank <= 6").collect()}
        if len(edges) == 8:
            assert plan_of(quick).count("Join") == 3
