"""Extraction of the graph by rules and by a model."""

import json
import sys

import pytest
from pyspark import cloudpickle

from quillmere import errors
from quillmere.engine import Engine
from quillmere.operators import graph
from quillmere.sources.providers import Deterministic

FILL = " The remaining words of this paragraph only serve to make it long enough for the extraction, which leaves out all chunks that are estimated at fewer than thirty tokens."


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have the tests on their path


class Model:
    """Names a person and an organization in chunks that have them; is silent, down or without relations where the text says so."""

    def __init__(self, down=False):
        self.down = down

    def embed(self, texts):
        return Deterministic(64).embed(texts)

    def chat(self, prompt):
        if self.down or "SILENT" in prompt:
            raise ConnectionError("down")
        if "KNOWN ENTITIES" in prompt:
            return "```json\n" + json.dumps({"relationships": [{"source": "Jane Doe", "target": "acme corp", "relation_type": "Requires", "description": "works there", "weight": 0.25}, {"source": "", "target": "acme corp"}]}) + "\n```"
        if "Jane" not in prompt:
            return "This was not found."
        return "Here: " + json.dumps({"language": "English", "entities": [{"name": " Jane Doe", "type": "Person", "description": "engineer", "name_en": "jane doe"}, {"name": "acme corp", "type": "organization", "description": "", "name_en": ""}, {"name": "safety"}, {"name": " "}]})


def edges_of(edges):
    return {(r["chunk_id"], r["source"], r["relation_type"], r["target"]) for r in edges.collect()}


def test_cue_verbs(spark):
    texts = [
        "ISO 9001 supersedes ISO 9000 in all plants.",
        "MIL-STD-810 has been superseded by ISO 9001 for such tests.",
        "ISO 9001 requires ISO 9000 and amends IEC 61850 here.",
        "ISO 9001 was printed. It requires care. ISO 9000 was printed too.",
        "La norma ISO 9001 modifica ISO 9000 en todo.",
    ]
    chunks = spark.createDataFrame([(i, t + FILL) for i, t in enumerate(texts)], "chunk_id bigint, content string")
    mentions, edges = graph.extract(chunks)
    assert mentions.columns == ["chunk_id", "name", "entity_type"]
    got = edges_of(edges)
    assert (0, "iso 9001", "supersedes", "iso 9000") in got and (2, "iso 9001", "requires", "iso 9000") in got and (2, "iso 9001", "amends", "iec 61850") in got
    assert any(e[0] == 1 and e[1:3] == ("iso 9001", "supersedes") for e in got) and not any(e[0] == 1 and e[1] != "iso 9001" and e[2] == "supersedes" for e in got)
    assert (4, "iso 9001", "amends", "iso 9000") in got
    assert {e[2] for e in got if e[0] == 3} == {"references"} and not any(e[0] == 0 and e[2] == "references" and {e[1], e[3]} == {"iso 9001", "iso 9000"} for e in got)


def test_a_model_names_entities_and_relations(spark):
    rows = [(1, "Jane Doe of Acme Corp signed the letter." + FILL), (2, "SILENT: ISO 9001 supersedes ISO 9000 here." + FILL), (3, "Nobody is named, but ISO 9001 is." + FILL), (4, "Jane, short.")]
    mentions, edges = graph.extract(spark.createDataFrame(rows, "chunk_id bigint, content string"), provider=Model())
    got = {(r["chunk_id"], r["name"]): (r["entity_type"], r["description"], r["name_en"]) for r in mentions.collect()}
    assert got[1, "jane doe"] == ("person", "engineer", "jane doe") and got[1, "acme corp"] == ("organization", None, None) and got[1, "safety"][0] == "concept"
    assert {k for k in got if k[0] == 1} == {(1, "jane doe"), (1, "acme corp"), (1, "safety")} and (2, "iso 9001") in got and (3, "iso 9001") in got
    assert edges_of(edges) == {(1, "jane doe", "requires", "acme corp"), (2, "iso 9001", "supersedes", "iso 9000")}
    assert [r["weight"] for r in edges.where("chunk_id = 1").collect()] == [0.25]
    with pytest.raises(errors.ExtractionFailed):
        graph.extract(spark.createDataFrame(rows, "chunk_id bigint, content string"), provider=Model(down=True))


def test_the_engine_asks_its_model(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"), provider=Model())
    engine._graph(spark.createDataFrame([(1, "Jane Doe of Acme Corp signed the letter." + FILL)], "chunk_id bigint, content string"))
    found = {r["name"]: r for r in engine.store.table("entities").collect()}
    assert found["jane doe"]["entity_type"] == "person" and found["jane doe"]["description"] == "engineer" and found["jane doe"]["name_en"] == "jane doe"
    tied = engine.store.table("relationships").collect()
    assert [(r["relation_type"], r["weight"], r["description"], r["source_entity_id"]) for r in tied] == [("requires", 0.25, "works there", found["jane doe"]["id"])]
