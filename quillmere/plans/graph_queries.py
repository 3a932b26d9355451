"""The knowledge graph over the star schema, with SQL.

Entities: names of parts (concept), suppliers (organization), nations (term) and customers (person).  Edges: a part's name to the suppliers that ship
it, weighing the greatest discount; suppliers and customers to their nations.  Chunks: orders, which mention their customer and parts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmere.operators import graph, retrieval
from quillmere.operators import store as S
from quillmere.plans.registry import query, table

_ENTITIES = """e AS (SELECT min(p_partkey) * 4 AS id, p_name AS name, NULL::VARCHAR AS name_en, 'concept' AS entity_type FROM part GROUP BY p_name
 UNION ALL SELECT s_suppkey * 4 + 1, lower(s_name), s_name, 'organization' FROM supplier
 UNION ALL SELECT n_nationkey::BIGINT * 4 + 2, lower(n_name), NULL, 'term' FROM nation
 UNION ALL SELECT c_custkey * 4 + 3, lower(c_name), NULL, 'person' FROM customer)"""
_EDGES = """pid AS (SELECT p_name, min(p_partkey) * 4 AS id FROM part GROUP BY 1),
r AS (SELECT pid.id AS s, l_suppkey * 4 + 1 AS t, 'references' AS relation_type, max(l_discount) AS weight FROM lineitem JOIN part ON p_partkey = l_partkey JOIN pid USING (p_name) GROUP BY ALL
 UNION ALL SELECT s_suppkey * 4 + 1, s_nationkey::BIGINT * 4 + 2, 'requires', 0.9::DOUBLE FROM supplier
 UNION ALL SELECT c_custkey * 4 + 3, c_nationkey::BIGINT * 4 + 2, 'references', 0.3::DOUBLE FROM customer),
both_ways AS (SELECT s AS node, t AS other, weight FROM r UNION ALL SELECT t, s, weight FROM r)"""
_MENTIONS = """ec AS (SELECT DISTINCT pid.id AS entity_id, l_orderkey AS chunk_id FROM lineitem JOIN part ON p_partkey = l_partkey JOIN pid USING (p_name)
 UNION ALL SELECT o_custkey * 4 + 3, o_orderkey FROM orders)"""
#: Every brand is a question for the names of its parts, every supplier for the beginning of its name.
_TERMS = """terms AS (SELECT DISTINCT regexp_extract(p_brand, '[0-9]+')::BIGINT AS query_id, p_name AS term FROM part UNION ALL SELECT 1000 + s_suppkey, left(lower(s_name), 16) FROM supplier
 UNION ALL SELECT 1000000 + n_nationkey::BIGINT, lower(n_name) FROM nation)"""
_HITS = """exact AS (SELECT DISTINCT query_id, id, name FROM terms JOIN e ON term = name),
fuzzy AS (SELECT query_id, id FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS n FROM (SELECT DISTINCT query_id, id FROM terms JOIN e ON contains(lower(name), term) WHERE strlen(term) >= 4)) WHERE n <= 50),
english AS (SELECT query_id, id FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS n FROM (SELECT DISTINCT query_id, id FROM terms JOIN e ON contains(lower(name_en), term) WHERE strlen(term) >= 4)) WHERE n <= 50),
found AS (SELECT query_id, id, arg_min(way, n) AS found_by FROM (SELECT query_id, id, 1 AS n, 'exact' AS way FROM exact UNION ALL SELECT query_id, id, 2, 'fuzzy' FROM fuzzy UNION ALL SELECT query_id, id, 3, 'name_en' FROM english) GROUP BY ALL)"""


def entities(spark, sf):
    t = lambda name: table(spark, sf, name)
    none = F.lit(None).cast("string")
    rows = [
        t("part").groupBy("p_name").agg((F.min("p_partkey") * 4).alias("id")).select("id", F.col("p_name").alias("name"), none.alias("name_en"), F.lit("concept").alias("entity_type")),
        t("supplier").select((F.col("s_suppkey") * 4 + 1).alias("id"), F.lower("s_name"), "s_name", F.lit("organization")),
        t("nation").select((F.col("n_nationkey").cast("bigint") * 4 + 2).alias("id"), F.lower("n_name"), none, F.lit("term")),
        t("customer").select((F.col("c_custkey") * 4 + 3).alias("id"), F.lower("c_name"), none, F.lit("person")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


def _named_parts(spark, sf):
    """(l_partkey, id): the entity of every part, by its name."""
    part = table(spark, sf, "part")
    first = part.groupBy("p_name").agg((F.min("p_partkey") * 4).alias("id"))
    return part.join(first, "p_name").select(F.col("p_partkey").alias("l_partkey"), "id")


def relationships(spark, sf):
    t = lambda name: table(spark, sf, name)
    # the map side combines lines by part before they meet the parts' names
    shipped = t("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max("l_discount").alias("w")).join(_named_parts(spark, sf), "l_partkey")
    rows = [
        shipped.groupBy("id", "l_suppkey").agg(F.max("w").alias("weight")).select(F.col("id").alias("source_entity_id"), (F.col("l_suppkey") * 4 + 1).alias("target_entity_id"), F.lit("references").alias("relation_type"), "weight"),
        t("supplier").select(F.col("s_suppkey") * 4 + 1, F.col("s_nationkey").cast("bigint") * 4 + 2, F.lit("requires"), F.lit(0.9)),
        t("customer").select(F.col("c_custkey") * 4 + 3, F.col("c_nationkey").cast("bigint") * 4 + 2, F.lit("references"), F.lit(0.3)),
    ]
    return rows[0].union(rows[1]).union(rows[2])


def entity_chunks(spark, sf):
    """(entity_id, chunk_id), some of them twice; searches don't mind, and so all lines needn't be shuffled to drop them."""
    by_part = table(spark, sf, "lineitem").join(_named_parts(spark, sf), "l_partkey").select(F.col("id").alias("entity_id"), F.col("l_orderkey").alias("chunk_id"))
    return by_part.union(table(spark, sf, "orders").select(F.col("o_custkey") * 4 + 3, "o_orderkey"))


def terms(spark, sf):
    brands = table(spark, sf, "part").select(F.regexp_extract("p_brand", "[0-9]+", 0).cast("bigint").alias("query_id"), F.col("p_name").alias("term")).distinct()
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey") + 1000, F.left(F.lower("s_name"), F.lit(16)))
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint") + 1_000_000, F.lower("n_name"))
    return brands.union(suppliers).union(nations)


def seeds(spark, sf):
    return graph.matched_entities(entities(spark, sf), terms(spark, sf)).select("query_id", "id")


@query(f"WITH {_ENTITIES}, {_TERMS}, {_HITS} SELECT query_id, id, name FROM exact")
def entity_exact(spark, sf):
    return graph.exact_entities(entities(spark, sf), terms(spark, sf))


@query(f"WITH {_ENTITIES}, {_TERMS}, {_HITS} SELECT query_id, id FROM fuzzy")
def entity_fuzzy(spark, sf):
    return graph.fuzzy_entities(entities(spark, sf), terms(spark, sf)).select("query_id", "id")


@query(f"WITH {_ENTITIES}, {_TERMS}, {_HITS} SELECT query_id, id, found_by FROM found")
def entity_union(spark, sf):
    return graph.matched_entities(entities(spark, sf), terms(spark, sf))


@query(f"""
WITH {_ENTITIES}, {_TERMS}, {_HITS}, {_EDGES}, {_MENTIONS}, w AS (SELECT node, max(weight) AS w FROM both_ways GROUP BY 1),
s AS (SELECT query_id, chunk_id, coalesce(max(w), 0.5::DOUBLE) AS score FROM (SELECT DISTINCT query_id, id FROM found) JOIN ec ON entity_id = id LEFT JOIN w ON node = id GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 20
""")
def graph_search(spark, sf):
    return graph.search_chunks(seeds(spark, sf), entity_chunks(spark, sf), relationships(spark, sf), top=20)


@query(f"""
WITH {_ENTITIES}, {_TERMS}, {_HITS}, {_EDGES}, near AS (SELECT DISTINCT query_id, other AS id FROM found JOIN both_ways ON node = id)
SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id) AS n FROM (SELECT * FROM near ANTI JOIN found USING (query_id, id))) WHERE n <= 100
""")
def one_hop(spark, sf):
    return graph.neighbours(seeds(spark, sf), relationships(spark, sf))


@query(f"""
WITH RECURSIVE {_EDGES}, b AS (SELECT query_id, id, depth FROM (SELECT n_nationkey::BIGINT AS query_id, n_nationkey::BIGINT * 4 + 2 AS id, 0 AS depth FROM nation)),
walk AS (SELECT * FROM b UNION SELECT query_id, other, depth + 1 FROM walk JOIN (SELECT DISTINCT node, other FROM both_ways) ON node = id WHERE depth < 2)
SELECT query_id, id, min(depth)::INT AS depth FROM walk GROUP BY ALL
""")
def bfs_depth_n(spark, sf):
    """Two steps around every nation."""
    start = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("query_id"), (F.col("n_nationkey").cast("bigint") * 4 + 2).alias("id"))
    return graph.traverse(start, relationships(spark, sf), 2)


_NEAREST = """e AS (SELECT a.vec_id AS s, b.vec_id AS t, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6), b.vec_id) AS n
 FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), u AS (SELECT s AS x, t AS y FROM e WHERE n = 1 UNION SELECT t, s FROM e WHERE n = 1)"""


def nearest_edges(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    hits = retrieval.nearest(vectors, vectors.withColumnRenamed("vec_id", "query_id"), 1, exclude_self=True)
    return hits.select(F.col("query_id").alias("source_entity_id"), F.col("vec_id").alias("target_entity_id"), F.lit(1.0).alias("weight"))


def _nodes(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))


@query(f"WITH RECURSIVE {_NEAREST}, reach AS (SELECT vec_id AS id, vec_id AS here FROM embeddings UNION SELECT id, y FROM reach JOIN u ON x = here) SELECT id, min(here) AS component FROM reach GROUP BY id")
def components(spark, sf):
    """Components of the graph that ties every vector to its nearest."""
    return graph.components(_nodes(spark, sf), nearest_edges(spark, sf))


@query(f"""
WITH RECURSIVE {_NEAREST}, reach AS (SELECT vec_id AS id, vec_id AS here FROM embeddings UNION SELECT id, y FROM reach JOIN u ON x = here), c AS (SELECT id, min(here) AS component FROM reach GROUP BY id)
SELECT count(DISTINCT component) AS n_components, (SELECT max(n) FROM (SELECT count(*) AS n FROM c GROUP BY component)) AS largest FROM c
""")
def component_sizes(spark, sf):
    sizes = graph.components(_nodes(spark, sf), nearest_edges(spark, sf)).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("n_components"), F.max("n").alias("largest"))


@query()
def modularity(spark, sf):
    """Communities of both levels; greedy moves are no SQL."""
    return graph.communities(_nodes(spark, sf), nearest_edges(spark, sf))


@query(f"""
WITH {_ENTITIES}, g AS (SELECT (id // 4) % 10 AS community, id, '- ' || name || ' (' || entity_type || ')' AS line FROM e)
SELECT 0 AS level, community, string_agg(line, chr(10) ORDER BY id) AS text FROM g GROUP BY community
""")
def community_texts(spark, sf):
    """What a summary of a community is made from."""
    own = entities(spark, sf).withColumn("description", F.lit(""))
    made = own.groupBy((F.floor(F.col("id") / 4) % 10).alias("community")).agg(F.collect_list("id").alias("entity_ids")).select(F.lit(0).alias("level"), "community", "entity_ids")
    return graph.community_text(made, own)


@query(f"""
WITH {_ENTITIES}, ed AS (SELECT o_orderkey AS chunk_id, lower(c_name) AS source, lower(n_name) AS target, -1.0::DOUBLE AS weight FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
f AS (SELECT name, min(id) AS id FROM e GROUP BY 1)
SELECT chunk_id, a.id AS source_entity_id, b.id AS target_entity_id, 'references' AS relation_type, CASE WHEN weight <= 0 THEN 1.0::DOUBLE ELSE weight END AS weight FROM ed JOIN f a ON a.name = source JOIN f b ON b.name = target
""")
def resolve_endpoints(spark, sf):
    """Edges of names to edges of ids: the customer is among the chunk's own entities, the nation is found anywhere."""
    t = lambda name: table(spark, sf, name)
    named = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    edges = named.select(F.col("o_orderkey").alias("chunk_id"), F.lower("c_name").alias("source"), F.lower("n_name").alias("target"), F.lit("references").alias("relation_type"), F.lit(-1.0).alias("weight"))
    local = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("chunk_id"), F.lower("c_name").alias("name"), (F.col("c_custkey") * 4 + 3).alias("id"))
    return graph.resolve_endpoints(edges, local, entities(spark, sf))


@query()
def graph_extract(spark, sf):
    """Mentions of entities found without a model, in every paragraph of at least 30 tokens."""
    from quillmere.plans.text_queries import paragraph_chunks

    return graph.extract(paragraph_chunks(spark, sf))[0]


@query()
def graph_extract_edges(spark, sf):
    """Relations of those entities: by cue verbs, else as references."""
    from quillmere.plans.text_queries import paragraph_chunks

    return graph.extract(paragraph_chunks(spark, sf))[1]


# ------------------------------------------------------------------------------------------------ the store


@query("SELECT p_name AS name, p_type AS entity_type, arg_max(p_brand, p_partkey) AS description FROM part GROUP BY ALL")
def upsert_entities(spark, sf):
    """Parts as a stream of entities: the last one of a name and type wins."""
    rows = table(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("entity_type"), F.col("p_brand").alias("description"), F.col("p_partkey").alias("seq"))
    return S.last_wins(rows, ["name", "entity_type"], "seq").drop("seq")


@query("""
SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS version FROM customer
UNION ALL SELECT 10000000 + s_suppkey, 'new', 2 FROM supplier
""")
def upsert_documents(spark, sf):
    """Keyed upsert: every third customer is changed, suppliers are new."""
    old = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.lit(1).alias("version"))
    changed = table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.lower("c_mktsegment").alias("segment"), F.lit(2).alias("version"))
    new = table(spark, sf, "supplier").select((F.col("s_suppkey") + 10_000_000).alias("id"), F.lit("new").alias("segment"), F.lit(2).alias("version"))
    return S.upsert(old, changed.unionByName(new), ["id"])


@query("""
WITH gone AS (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus = 'F')
SELECT 'orders' AS table_name, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT * FROM gone)
UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT * FROM gone)
""")
def cascade_delete(spark, sf):
    """Deleting documents takes their chunks along; orders and lines stand for both."""
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    gone = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    left = S.cascade({"orders": (orders, "o_orderkey"), "lineitem": (lines, "l_orderkey")}, gone)
    return S.counts(left)


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in "customer events lineitem orders part supplier".split()))
def table_stats(spark, sf):
    return S.counts({t: table(spark, sf, t) for t in "customer events lineitem orders part supplier".split()})
