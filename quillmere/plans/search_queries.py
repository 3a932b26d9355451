"""Inverted index, BM25, nearest neighbours and fusion, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmere.functions import text as T
from quillmere.operators import graph, retrieval
from quillmere.plans import duck as D
from quillmere.plans.registry import query, table
from quillmere.plans.text_queries import _PARAS, paragraph_chunks

TERMS = r"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{Nd}}]+'), lambda w: w <> '')"


def terms_sql(x: str) -> str:
    return TERMS.format(x=x)


_TOKENS = f"{_PARAS}, tok AS (SELECT chunk_id, {terms_sql('content')} AS ts FROM chunks), occ AS (SELECT chunk_id, len(ts) AS dl, unnest(ts) AS term FROM tok)"
#: Expects chunks(chunk_id, content) and q(query_id, question); gives hits(query_id, chunk_id, score, matched).
_BM25 = f"""tok AS (SELECT chunk_id, {terms_sql('content')} AS ts FROM chunks), occ AS (SELECT chunk_id, len(ts) AS dl, unnest(ts) AS term FROM tok),
 asked AS (SELECT query_id, unnest(list_distinct(list_filter({terms_sql('question')}, lambda w: strlen(w) > 2 AND NOT list_contains({D.lst(T.RETRIEVAL_STOPS)}, w)))) AS term FROM q),
 post AS (SELECT term, chunk_id, dl, count(*) AS tf FROM occ GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM post GROUP BY term), st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM tok),
 hits AS (SELECT query_id, chunk_id, round(sum(greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score, count(*) AS matched
 FROM asked JOIN post USING (term) JOIN df USING (term) CROSS JOIN st GROUP BY query_id, chunk_id)"""


def top_sql(hits: str, k: int, key: str = "chunk_id", columns: str = "*") -> str:
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {key}) AS rank FROM {hits}) WHERE rank <= {k}"


def benchmark_questions(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


@query(f"WITH {_TOKENS} SELECT chunk_id, term, count(*) AS tf FROM occ GROUP BY ALL")
def postings(spark, sf):
    return retrieval.postings(paragraph_chunks(spark, sf))


@query(f"WITH {_TOKENS} SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS occurrences FROM occ GROUP BY term")
def df_stats(spark, sf):
    # one chunk is in one task of the first aggregation, so documents and occurrences come from the same postings
    return retrieval.postings(paragraph_chunks(spark, sf)).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").cast("bigint").alias("occurrences"))


@query(f"WITH {_PARAS}, q AS (SELECT item_id AS query_id, text AS question FROM benchmark), {_BM25} {top_sql('hits', 10, columns='query_id, chunk_id, score, matched, rank, chunk_id // 100000 AS doc_id')}")
def bm25_topk(spark, sf):
    """Documents -> paragraphs -> postings -> the ten best paragraphs of every benchmark question."""
    hits = retrieval.bm25(paragraph_chunks(spark, sf), benchmark_questions(spark, sf), top=10)
    return hits.withColumn("doc_id", F.floor(F.col("chunk_id") / 100_000).cast("bigint"))


@query()
def bm25_stemmed(spark, sf):
    """The same over stemmed, accent-folded terms, with the full phrase of a question counted as one more term; SQL has no stemmer here."""
    from quillmere.operators import fulltext

    return fulltext.search(paragraph_chunks(spark, sf), benchmark_questions(spark, sf), top=10)


def _knn_sql(distance: str, k: int) -> str:
    return f"""
WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round({distance}, 6) + 0.0::DOUBLE AS distance FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p) WHERE rank <= {k}"""


def _knn(spark, sf, metric: str, k: int):
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return retrieval.nearest(vectors, vectors.withColumnRenamed("vec_id", "query_id"), k, metric, exclude_self=True)


@query(_knn_sql("list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])", 10))
def knn_l2(spark, sf):
    """Ten nearest of every vector."""
    return _knn(spark, sf, "l2", 10)


@query(_knn_sql("1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])", 10))
def knn_cosine(spark, sf):
    return _knn(spark, sf, "cosine", 10)


@query(_knn_sql("-list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])", 10))
def knn_dot(spark, sf):
    return _knn(spark, sf, "dot", 10)


#: Documents as chunks: a document's vector is that of its number, its entity is its source; a question's vector is that of its number.
_LEGS = f"""chunks AS (SELECT doc_id AS chunk_id, text AS content FROM documents), q AS (SELECT item_id AS query_id, text AS question FROM benchmark), {_BM25},
 f AS ({top_sql('hits', 20)}),
 v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS rank FROM (SELECT q.query_id, b.vec_id AS chunk_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS d
  FROM q JOIN embeddings a ON a.vec_id = q.query_id JOIN embeddings b ON b.vec_id <> a.vec_id)) WHERE rank <= 20),
 g AS (SELECT * FROM (SELECT q.query_id, d.doc_id AS chunk_id, row_number() OVER (PARTITION BY q.query_id ORDER BY d.doc_id) AS rank FROM q JOIN documents s ON s.doc_id = q.query_id JOIN documents d ON d.source = s.source) WHERE rank <= 20),
 legs AS (SELECT query_id, chunk_id, 'vector' AS leg, rank FROM v UNION ALL SELECT query_id, chunk_id, 'fts', rank FROM f UNION ALL SELECT query_id, chunk_id, 'graph', rank FROM g)"""


def three_legs(spark, sf, k: int = 20):
    """(query_id, chunk_id, leg, rank) of every benchmark question."""
    asked, docs = benchmark_questions(spark, sf), table(spark, sf, "documents")
    fts = retrieval.bm25(docs.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")), asked, top=k)
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    own = vectors.join(asked.select(F.col("query_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("query_id"), "embedding")
    near = retrieval.nearest(vectors, own, k, exclude_self=True).withColumnRenamed("vec_id", "chunk_id")
    # a source is an entity that its documents mention
    sources = docs.groupBy("source").agg(F.min("doc_id").alias("id"))
    mentions = docs.join(sources, "source").select(F.col("id").alias("entity_id"), F.col("doc_id").alias("chunk_id"))
    seeds = mentions.select(F.col("chunk_id").alias("query_id"), F.col("entity_id").alias("id")).join(asked.select("query_id"), "query_id", "left_semi")
    none = spark.createDataFrame([], "source_entity_id bigint, target_entity_id bigint, weight double")
    by_graph = graph.search_chunks(seeds, mentions, none, top=k)
    leg = lambda df, name: df.select("query_id", "chunk_id", F.lit(name).alias("leg"), "rank")
    return leg(near, "vector").unionByName(leg(fts, "fts")).unionByName(leg(by_graph, "graph"))


_WEIGHTS = f"""w AS (SELECT query_id, CASE WHEN {"(" + " OR ".join(D.matches("question", p) for p in T.ROUTE_PATTERNS) + ")"} THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS wv FROM q)"""


@query(f"""
WITH {_LEGS}, {_WEIGHTS}, s AS (SELECT query_id, chunk_id, round(sum(CASE leg WHEN 'vector' THEN wv WHEN 'fts' THEN 1.0::DOUBLE + 2 * (1.0::DOUBLE - wv) ELSE 0.5::DOUBLE END / (60 + rank)), 9) AS score,
 min(rank) FILTER (leg = 'vector') AS vec_rank, min(rank) FILTER (leg = 'fts') AS fts_rank, min(rank) FILTER (leg = 'graph') AS graph_rank FROM legs JOIN w USING (query_id) GROUP BY ALL)
SELECT *, concat_ws(',', CASE WHEN vec_rank IS NOT NULL THEN 'vector' END, CASE WHEN fts_rank IS NOT NULL THEN 'fts' END, CASE WHEN graph_rank IS NOT NULL THEN 'graph' END) AS methods FROM ({top_sql('s', 20)})
""")
def hybrid_search(spark, sf):
    """Routed weights, three legs, fusion with provenance: the reference's search over a batch of questions in one plan."""
    weights = retrieval.route(benchmark_questions(spark, sf)).withColumn("max_results", F.lit(20))
    return retrieval.fuse(three_legs(spark, sf), weights)


@query(f"""
WITH {_LEGS}, one AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS place FROM v), n AS (SELECT query_id, max(rank) AS last FROM f GROUP BY 1),
 new AS (SELECT v.query_id, v.chunk_id, v.rank FROM v ANTI JOIN f ON v.query_id = f.query_id AND v.chunk_id = f.chunk_id)
SELECT query_id, chunk_id, rank FROM f UNION ALL SELECT new.query_id, new.chunk_id, row_number() OVER (PARTITION BY new.query_id ORDER BY new.rank, new.chunk_id) + coalesce(last, 0) FROM new LEFT JOIN n ON n.query_id = new.query_id
""")
def followup_merge(spark, sf):
    """Results of a second search behind those of the first, without repeats."""
    legs = three_legs(spark, sf)
    leg = lambda name: legs.where(F.col("leg") == name).select("query_id", "chunk_id", "rank")
    return retrieval.merge_followup(leg("fts"), leg("vector"))



@query(f"""
WITH d AS (SELECT doc_id, text, coalesce(string_split(text, chr(10))[1], '') AS answer, flatten([{", ".join(D.find_all("text", p) for p in T.ANSWER_PATTERNS)}]) AS ids FROM documents),
 e AS (SELECT doc_id, text, answer, list_filter(ids, lambda s: s <> '') AS ids FROM d), k AS (SELECT doc_id, text, answer, list_filter(ids, lambda s, i: list_position(list_transform(ids, lambda x: lower(x)), lower(s)) = i) AS ids FROM e)
SELECT doc_id, list_filter(ids, lambda s: NOT contains(lower(answer), lower(s)) AND NOT regexp_matches(right(split_part(lower(text), lower(s), 1), 10), '({retrieval.NUMBERED}) $')) AS missing FROM k
""")
def missing_identifiers(spark, sf):
    """Identifiers of a document that its first line doesn't hold: what a follow-up search would ask for."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("answer"), F.coalesce(F.element_at(F.split("text", "\n"), 1), F.lit("")).alias("corpus"))
    return retrieval.missing_terms(docs).select("doc_id", "missing")


@query("SELECT source, lang AS language, n AS votes FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS r FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)) WHERE r = 1")
def language_vote(spark, sf):
    return graph.language_vote(table(spark, sf, "documents").select("source", F.col("lang").alias("language")), "source", "language")


@query(f"WITH {_PARAS} SELECT DISTINCT doc_id, lang FROM chunks WHERE lang <> '' AND contains(lower(content), 'version')")
def content_substring(spark, sf):
    """Documents in which some chunk holds a text, in any case."""
    return paragraph_chunks(spark, sf).where((F.col("lang") != "") & F.contains(F.lower("content"), F.lit("version"))).select("doc_id", "lang").distinct()


@query()
def query_entities(spark, sf):
    """Entities of every user's question in the order of the rules: quoted, capitalised runs, standards, sections, long words; an ordered state machine that SQL lacks."""
    from quillmere.operators import entities
    from quillmere.plans.text_queries import questions

    return questions(spark, sf).select("query_id", entities.query_entities(F.col("question")).alias("entities"))


@query()
def embedding_texts(spark, sf):
    """Texts as they are embedded, and vectors of the offline provider."""
    from quillmere.operators import embedding

    chunks = paragraph_chunks(spark, sf).withColumn("heading", F.col("lang"))
    return embedding.embed(chunks, embedding.Deterministic()).select("chunk_id", "embedding", "error")


@query(f"""
WITH {_PARAS}, w AS (SELECT chunk_id, CASE WHEN lang <> '' THEN lang || ': ' || content ELSE content END AS w FROM chunks),
h AS (SELECT chunk_id, w, left(w, coalesce(list_max(list_filter(range(1, 101), lambda i: strlen(left(w, i)) <= 100)), 0)) AS head FROM w)
SELECT chunk_id, CASE WHEN strlen(w) <= 100 THEN w ELSE regexp_replace(head, ' [^ ]*$', '') END AS text FROM h
""")
def embedding_cut(spark, sf):
    """Texts as they are embedded, cut at a hundred bytes, as the production bound would cut none of these."""
    from quillmere.operators import embedding

    chunks = paragraph_chunks(spark, sf)
    return chunks.select("chunk_id", embedding.embedding_text(F.col("lang"), F.col("content"), 100).alias("text"))


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def windowed_counts(spark, sf):
    """Events by hour and kind, as a batch."""
    from quillmere.streaming import ingest

    return ingest.windowed_counts(table(spark, sf, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("""
WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL)
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, event_type, n, total FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)
""")
def windowed_stream(spark, sf):
    """The same as a stream that is read to its end: the windows that the watermark has closed."""
    from quillmere.streaming import ingest

    return ingest.closed_windows(spark, sf, "events.parquet", table(spark, sf, "events").schema).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))
