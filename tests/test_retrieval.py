"""Search: plans, phrases and groups of terms, containment by keys, translations, traces, captions, summaries."""

import json
import random
import re
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillmere.config import Config
from quillmere.engine import Engine
from quillmere.operators import captions, evaluation, fulltext, graph, retrieval
from quillmere.sources.providers import Deterministic, OpenAIStyle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have the tests on their path


def test_texts_are_cut_once_a_chunk(spark):
    chunks = spark.createDataFrame([(1, "a b c"), (2, "b b d")], "chunk_id bigint, content string")
    asked = spark.createDataFrame([(1, "bbb ddd")], "query_id bigint, question string")
    plan = retrieval.bm25(chunks, asked, top=3)._jdf.queryExecution().optimizedPlan().toString()
    lines, seen = plan.split("\n"), 0
    indent = lambda line: len(re.match(r"[ :+-]*", line).group())
    for i, line in enumerate(lines):
        if "Generate explode(ts" in line:
            depth, seen = indent(line), seen + 1
            for above in reversed(lines[:i]):
                if indent(above) < depth:
                    depth = indent(above)
                    assert "split(" not in above
    assert seen


def test_scores_of_a_hand_made_corpus(spark):
    chunks = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (2, "artificial intelligence and machine learning"), (3, "quantum computing uses qubits"), (4, "")], "chunk_id bigint, content string")
    asked = spark.createDataFrame([(1, "artificial intelligence"), (2, "zzzyyyxxx"), (3, None)], "query_id bigint, question string")
    hits = retrieval.bm25(chunks, asked).collect()
    assert [(h["query_id"], h["chunk_id"], h["rank"], h["matched"]) for h in hits] == [(1, 2, 1, 2)] and hits[0]["score"] > 0


def test_groups_count_where_all_their_words_are(spark):
    chunks = spark.createDataFrame([(1, "der hohe Druck der Pumpen"), (2, "der Druck allein"), (3, "eine Pumpe allein"), (4, "nothing")], "chunk_id bigint, content string")
    asked = spark.createDataFrame([(1, "pressure")], "query_id bigint, question string")
    groups = spark.createDataFrame([(1, "Druck Pumpen"), (1, "")], "query_id bigint, term string")
    assert fulltext.search(chunks, asked).count() == 0
    assert [r["chunk_id"] for r in fulltext.search(chunks, asked, groups=groups).collect()] == [1]
    kept = fulltext.index(chunks)
    assert [r["chunk_id"] for r in fulltext.search(None, asked, indexed=kept, groups=groups).collect()] == [1]


def test_containment_by_keys_is_containment(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gam-ma", "é", "x1", "--", "(", "delta.", "a"]
    contents = [" ".join(rng.choice(words) for _ in range(rng.randrange(12))) for _ in range(60)] + ["", None, "Alpha BETA", "..."]
    facts = {" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))).lower() for _ in range(80)} | {"lph", "pha be", "a", "--", ".", "ta gam", "nowhere at all", "zzz", "-", "(", "é x1"}
    chunks = spark.createDataFrame(list(enumerate(contents)), "chunk_id bigint, content string")
    got = {(r["low"], r["chunk_id"]) for r in evaluation.holding(chunks, spark.createDataFrame([(f,) for f in facts], "low string")).collect()}
    assert got == {(f, i) for f in facts for i, c in enumerate(contents) if c is not None and f in c.lower()}


def test_names_by_their_rarest_gram(spark):
    names = [f"supplier#{i:09}" for i in range(300)] + ["Übergröße", "ab", None]
    entities = spark.createDataFrame(list(enumerate(names)), "id bigint, name string")
    terms = spark.createDataFrame([(1, "supplier#00000012"), (2, "größe"), (3, "ab"), (4, "#000000299"), (1, "supplier#00000012")], "query_id bigint, term string")
    got = sorted((r["query_id"], r["id"]) for r in graph.fuzzy_entities(entities, terms).collect())
    assert got == sorted([(1, i) for i in range(120, 130)] + [(2, 300), (4, 299)])


def test_chunks_of_hot_entities_are_cut_before_the_join(spark):
    rng = random.Random(5)
    links = [(rng.randrange(6), rng.randrange(400)) for _ in range(900)]
    edges = [(a, b, rng.random()) for a, b in [(0, 1), (1, 2), (4, 4)]]
    seeds = [(q, rng.randrange(6)) for q in range(4) for _ in range(3)]
    frames = (spark.createDataFrame(seeds, "query_id bigint, id bigint"), spark.createDataFrame(links, "entity_id bigint, chunk_id bigint"), spark.createDataFrame(edges, "source_entity_id bigint, target_entity_id bigint, weight double"))
    whole = {tuple(r) for r in graph.search_chunks(*frames).where("rank <= 7").collect()}
    assert {tuple(r) for r in graph.search_chunks(*frames, top=7).collect()} == whole and len(whole) == 28


FILL = " The remaining words of this paragraph only serve to make it long enough for the extraction, which leaves out all chunks that are estimated at fewer than thirty tokens."


class Polyglot:
    """Says that chunks are German, translates one word, sums up, and sees."""

    def embed(self, texts):
        if any("FAIL" in t for t in texts):
            raise ConnectionError("no vectors")
        return Deterministic(16).embed(texts)

    def see(self, prompt, images):
        return f"a picture of {len(images[0][1])} bytes"

    def chat(self, prompt):
        if prompt.startswith("Translate"):
            return json.dumps({"pressure": "Druck", "pump": None})
        if prompt.startswith("Sum up"):
            return "a summary"
        if "KNOWN ENTITIES" in prompt:
            return json.dumps({"relationships": []})
        if "Extract all entities" in prompt:
            return json.dumps({"language": "German", "entities": [{"name": "Druck", "type": "concept"}]})
        return Deterministic().chat(prompt)


def test_engine_with_a_model(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.txt").write_text("Der Druck im Kessel steigt." + FILL)
    (folder / "b.txt").write_text("Nothing of the kind is here, only words that no question asks for." + FILL)
    engine = Engine(spark, str(tmp_path / "store"), Config(embedding_dim=16), provider=Polyglot())
    assert {r["status"] for r in engine.ingest(str(folder)).collect()} == {"ready"}
    assert {r["language"] for r in engine.documents().collect()} == {"German"}
    assert {r["summary"] for r in engine.store.table("communities").collect()} == {"a summary"}
    questions = spark.createDataFrame([(1, "pressure of the pump"), (2, "FAIL pressure")], "query_id bigint, question string")
    hits, trace = engine.traced(questions)
    first = next(r for r in hits.collect() if r["query_id"] == 1 and r["rank"] == 1)
    assert "fts" in first["methods"] and "graph" in first["methods"]  # by the translation alone
    t = {r["query_id"]: r for r in trace.collect()}
    assert t[1]["error"] is None and t[1]["vec_results"] > 0 and t[1]["fts_results"] > 0 and t[1]["fused_results"] == hits.where("query_id = 1").count()
    assert "no vectors" in t[2]["error"] and t[2]["vec_results"] == 0 and t[2]["fts_results"] > 0
    known = {(r["term"], r["translation"]) for r in engine.store.table("translations").collect()}
    assert ("pressure", "Druck") in known and ("pump", None) in known
    before = engine.store.table("translations").count()
    engine.search(questions).count()
    assert engine.store.table("translations").count() == before  # what there is no translation for isn't asked again
    source = engine.sources_of(hits).where("query_id = 1").first()["sources"][0]
    assert source["doc_metadata"] == {} and source["chunk_metadata"] == {}
    doc = engine.store.document(path=source["path"]).first()
    assert engine.store.document(id=doc["id"]).first()["path"] == doc["path"] and engine.store.chunks_of(doc["id"]).count() == 2
    engine.delete(source["path"])
    assert engine.store.table("chunk_terms").count() == engine.store.table("chunks").count() == 2


def test_captions_of_the_largest_images(spark):
    rows = [("p", 0, 1, 0, "image/png", 10, 10, bytearray(b"abc")), ("p", 0, 1, 1, None, 2, 2, bytearray(b"x")), ("p", 1, 2, 2, "image/png", 1, 1, None)]
    images = spark.createDataFrame(rows, "path string, section_idx int, page_number int, image_idx int, mime string, width int, height int, data binary")
    got = {r["image_idx"]: r["caption"] for r in captions.captioned(images, Polyglot()).collect()}
    assert got == {0: "a picture of 3 bytes", 1: None, 2: None}
    assert {r["caption"] for r in captions.captioned(images, Deterministic()).collect()} == {None}
    sections = spark.createDataFrame([("p", 0, "one"), ("p", 1, "two")], "path string, section_idx int, content string")
    marked = {r["section_idx"]: r["content"] for r in captions.with_marks(sections, captions.captioned(images, Polyglot()), "caption").collect()}
    assert marked == {0: "one\n[Image: a picture of 3 bytes]\n[image]", 1: "two\n[image]"}


def test_images_go_as_data_urls(monkeypatch):
    sent = {}
    server = OpenAIStyle("http://none", "m")
    monkeypatch.setattr(server, "post", lambda path, body: sent.update(body) or {"choices": [{"message": {"content": "seen"}}]})
    assert server.see("what?", [("image/png", b"\x00\x01")]) == "seen"
    assert sent["messages"][0]["content"][1]["image_url"]["url"] == "data:image/png;base64,AAE="


def test_rank_columns_of_a_null_question(spark):
    assert retrieval.route(spark.createDataFrame([(1, None)], "query_id bigint, question string")).agg(F.count(F.lit(1))).first()[0] == 1


class Counting:
    """Counts tokens as a server does: ten a call."""

    used = None

    def chat(self, prompt):
        self.used = 10
        return "It might be. According to the document, unclear." if "Earlier answer" not in prompt else "Better (a.pdf)."


def test_tokens_of_all_rounds_add_up(spark):
    from quillmere.operators import reasoning

    schema = "query_id bigint, question string, sources array<struct<filename string, heading string, content string, page_number int, chunk_id bigint, chunk_type string>>"
    asked = spark.createDataFrame([(1, "what?", [("a.pdf", "", "text", 1, 1, "paragraph")])], schema)
    assert reasoning.reason(asked, Counting(), threshold=0.99).first()["tokens"] == 20
    assert reasoning.reason(asked, Counting(), rounds=1).first()["tokens"] == 10
    assert reasoning.reason(asked, Deterministic()).first()["tokens"] is None
