"""The engine: ingest, query, update, delete over one store. Every call handles a batch: a folder of files, a table of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmere import errors
from quillmere.config import Config
from quillmere.functions import text as T
from quillmere.operators import captions, chunking, embedding, entities, evaluation, experiments, fulltext, graph, reasoning, retrieval
from quillmere.operators import store as S
from quillmere.operators.lineage import cut
from quillmere.sources import files as sources
from quillmere.sources.providers import Deterministic, Provider


class Engine:
    def __init__(self, spark: SparkSession, folder: str, config: Config | None = None, provider: Provider | None = None, registry: sources.Registry | None = None):
        self.spark, self.config = spark, config or Config()
        self.provider = provider or Deterministic(self.config.embedding_dim)
        self.registry = registry or sources.Registry()
        self.store: S.Store | None = S.Store(spark, folder)
        self.voted: DataFrame | None = None

    # -------------------------------------------------------------------------------------------- ingest

    def ingest(self, folder: str, force: bool = False, metadata: dict[str, str] | None = None) -> DataFrame:
        """Parse, chunk, embed and graph the files below ``folder`` that are new or changed; gives (path, status, error) of every file.

        A file whose hash is that of its last complete ingest is skipped. The hash counts only once a file is ready, so a failed file is tried again.
        """
        return self.ingest_files(sources.walk(self.spark, folder, tuple(self.registry.parsers)), force, metadata)

    def ingest_files(self, found: DataFrame, force: bool = False, metadata: dict[str, str] | None = None) -> DataFrame:
        """The same for rows of path, content, content_hash and format."""
        store = self._open()
        known = store.table("documents")
        old = known.select("path", F.col("id").alias("q_id"), F.col("content_hash").alias("q_hash"), F.col("status").alias("q_status"), F.col("created_at").alias("q_created"))
        # bytes of files aren't kept: what is needed of them is parsed below
        looked = found.join(old, "path", "left")
        same = F.coalesce((F.col("q_hash") == F.col("content_hash")) & (F.col("q_status") == "ready"), F.lit(False))
        todo = looked if force else looked.where(~same)
        parsed = cut(sources.sections(todo, self.registry), "sections")
        pictures = cut(sources.images(todo, self.registry), "images").where("error is null").withColumn("image_idx", F.row_number().over(W.partitionBy("path").orderBy("section_idx", "page_number", F.desc("width"), F.md5("data"))))
        fresh = todo.where("q_id is null").select("path")
        numbered = S.numbered(fresh, "path", store.next_id("documents"), name="q_new")
        failed = parsed.groupBy("path").agg(F.max("error").alias("q_error"))
        docs = todo.drop("content").join(numbered, "path", "left").join(failed, "path", "left")
        now = F.current_timestamp()
        meta = F.create_map(*[F.lit(x) for kv in (metadata or {}).items() for x in kv]).cast("map<string,string>")
        docs = cut(
            docs.select(
                F.coalesce("q_id", "q_new").alias("id"), "path", F.substring_index("path", "/", -1).alias("filename"), "format", F.when(F.col("q_error").isNull(), F.col("content_hash")).otherwise("").alias("content_hash"),
                F.lit("native").alias("parse_method"), F.when(F.col("q_error").isNull(), "ready").otherwise("error").alias("status"), meta.alias("metadata"), F.lit("").alias("language"), F.coalesce("q_created", now).alias("created_at"), now.alias("updated_at"), "q_error",
            ),
            "new-documents",
        )
        if docs.isEmpty():
            return found.select("path", F.lit("unchanged").alias("status"), F.lit(None).cast("string").alias("error"))
        good = parsed.where("error is null")
        if self.config.caption_images:
            pictures = cut(captions.captioned(pictures, self.provider), "captions")
        marked = captions.with_marks(good, pictures, "caption" if self.config.caption_images else None)
        rows = marked.join(docs.select("path", F.col("id").alias("doc_id")), "path").select("doc_id", "section_idx", "heading", "content", "section_type", "page_number")
        made = chunking.chunk_sections(rows, self.config.chunk_tokens, self.config.chunk_overlap, self.config.separator).withColumnRenamed("doc_id", "document_id")
        made = cut(S.number_chunks(made, store.next_id("chunks")), "new-chunks")
        vectors = cut(embedding.embed(made.select("id", "heading", "content"), self.provider).select(F.col("id").alias("chunk_id"), "embedding", "error"), "new-vectors")
        counts = vectors.agg(F.count(F.lit(1)).alias("n"), F.count("embedding").alias("ok")).first()
        if counts["n"] and not counts["ok"]:
            raise errors.EmbeddingFailed(vectors.select("error").first()["error"])
        store.delete_documents(docs.select("id"), registry=False)
        store.append("chunks", made)
        store.append("chunk_terms", fulltext.index(made.withColumnRenamed("id", "chunk_id"), heading="heading"))
        store.append("embeddings", vectors.where("embedding is not null").select("chunk_id", "embedding"))
        first = chunking.section_chunk_map(made.withColumnRenamed("document_id", "doc_id")).join(made.select(F.col("document_id").alias("doc_id"), "position_in_doc", F.col("id").alias("chunk_id")), ["doc_id", "position_in_doc"])
        placed = pictures.join(docs.select("path", F.col("id").alias("document_id")), "path").join(first.withColumnRenamed("doc_id", "document_id"), ["document_id", "section_idx"], "left")
        start = store.next_id("images")
        keyed = S.numbered(placed.withColumn("q_key", F.concat_ws("/", "document_id", "image_idx")), "q_key", start, name="id")
        store.append("images", keyed.select("id", "chunk_id", "document_id", "page_number", "mime", "width", "height", "data"))
        self.voted = None
        if not self.config.skip_graph:
            self._graph(made.select(F.col("id").alias("chunk_id"), "content"))
        if self.voted is not None:
            docs = docs.join(self.voted, "id", "left").withColumn("language", F.coalesce("q_language", "language")).drop("q_language")
        store.replace("documents", cut(S.upsert(known, docs.drop("q_error"), ["path"], keep=("created_at",)), "documents"))
        return found.select("path").join(docs.select("path", "status", F.col("q_error").alias("error")), "path", "left").select("path", F.coalesce("status", F.lit("unchanged")).alias("status"), "error")

    def _graph(self, chunks: DataFrame) -> None:
        """Entities, links, edges and communities; names that are known keep their ids."""
        store = self._open()
        # the offline provider names no entities: the rules stand in
        mentions, edges = graph.extract(chunks, provider=None if isinstance(self.provider, Deterministic) else self.provider)
        mentions, edges = cut(mentions, "mentions"), cut(edges, "edges")
        told = [c for c in ("description", "name_en") if c in mentions.columns]
        known = cut(store.table("entities"), "entities")
        named = mentions.groupBy("name", "entity_type").agg(*[F.max(c if c in told else F.lit(None).cast("string")).alias(c) for c in ("description", "name_en")])
        new = named.join(known.select("name", "entity_type"), ["name", "entity_type"], "left_anti").withColumn("q_key", F.concat_ws("\x1f", "entity_type", "name"))
        made = cut(S.numbered(new, "q_key", store.next_id("entities"), name="id").select("id", "name", "entity_type", "description", "name_en"), "new-entities")
        if told:  # what a model says now goes before what was known
            again = named.select("name", "entity_type", *[F.col(c).alias(f"q_{c}") for c in ("description", "name_en")])
            both = known.join(again, ["name", "entity_type"], "left")
            known = cut(both.select(*[F.coalesce(f"q_{c}", c).alias(c) if c in told else F.col(c) for c in known.columns]), "entities")
            store.replace("entities", known)
        every = cut(known.select(*made.columns).unionByName(made), "all-entities")
        store.append("entities", made)
        local = mentions.join(every, ["name", "entity_type"]).select("chunk_id", "name", "id")
        store.append("entity_chunks", local.select(F.col("id").alias("entity_id"), "chunk_id").distinct())
        store.append("relationships", graph.resolve_endpoints(edges, local, every).withColumn("source_chunk_id", F.col("chunk_id")))
        found = cut(graph.communities(every.select("id"), store.table("relationships")), "communities")
        texts = graph.community_text(found, every)
        # the offline provider has nothing to say of a list: the list itself stands
        summed = texts.withColumnRenamed("text", "summary") if isinstance(self.provider, Deterministic) else experiments.summarise(texts, self.provider).drop("text")
        store.replace("communities", found.join(summed, ["level", "community"], "left"))
        self._languages(mentions)

    def _languages(self, mentions: DataFrame) -> None:
        """The language of every document with chunks a model told the language of: the commonest one."""
        if "language" not in mentions.columns:
            return
        store = self._open()
        told = mentions.select("chunk_id", "language").distinct().join(store.table("chunks").select(F.col("id").alias("chunk_id"), "document_id"), "chunk_id")
        votes = graph.language_vote(told, "document_id", "language").select(F.col("document_id").alias("id"), F.col("language").alias("q_language"))
        self.voted = cut(votes, "languages")

    def update(self, path: str) -> DataFrame:
        """Ingest one registered file again if it has changed."""
        if self._open().table("documents").where(F.col("path") == path).isEmpty():
            raise errors.NotFound(path)
        return self.ingest_files(sources.hashed(self.spark.read.format("binaryFile").load(path)))

    def update_all(self) -> DataFrame:
        """Every registered file; the ones that no longer exist have the status ``missing``."""
        registered = cut(self._open().table("documents").select("path"), "registered")
        folders = [r[0] for r in registered.select(F.expr("left(path, length(path) - length(substring_index(path, '/', -1)) - 1)").alias("f")).distinct().toLocalIterator()]
        if not folders:
            return self.spark.createDataFrame([], "path string, status string, error string")
        there = sources.hashed(self.spark.read.format("binaryFile").load(folders)).join(registered, "path", "left_semi")
        done = self.ingest_files(there)
        return registered.join(done, "path", "left").select("path", F.coalesce("status", F.lit("missing")).alias("status"), "error")

    def delete(self, path: str) -> None:
        """A document with everything that hangs on it; entities stay."""
        ids = self._open().table("documents").where(F.col("path") == path).select("id")
        if ids.isEmpty():
            raise errors.NotFound(path)
        self._open().delete_documents(cut(ids, "deleted"))

    def documents(self) -> DataFrame:
        return self._open().table("documents").orderBy(F.desc("created_at"), "id")

    # -------------------------------------------------------------------------------------------- query

    def _terms(self, routed: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """(query_id, term) of the entities of every question, and (query_id, term) of their translations into the corpus's languages, if there are any.

        What the cache of translations lacks is asked for once and remembered, also where there is none.
        """
        store = self._open()
        terms = cut(routed.select("query_id", F.explode(entities.query_entities(F.col("question"))).alias("term")).withColumn("term", F.lower("term")).distinct(), "terms")
        languages = entities.corpus_languages(store.table("documents"))
        if isinstance(self.provider, Deterministic) or not self.config.translate_terms or languages.isEmpty():
            return terms, None
        missing = cut(entities.untranslated(terms, store.table("translations"), languages), "untranslated")
        if not missing.isEmpty():
            store.append("translations", entities.translated(missing, self.provider))
        every = cut(entities.expand(terms, store.table("translations"), languages), "expanded")
        return every.select("query_id", F.lower("term").alias("term")).distinct(), every.where("language is not null").select("query_id", "term")

    def _legs(self, questions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(routed questions, (query_id, chunk_id, leg, rank) of the three legs, (query_id, error) of the questions that got no vector)."""
        store = self._open()
        c = self.config
        routed = cut(retrieval.route(questions, c.weight_vector, c.weight_fts, c.weight_graph), "routed")
        most = routed.agg(F.max("max_results")).first()[0] or c.max_results
        terms, translations = self._terms(routed)
        # stems of headings and contents are kept in the store
        fts = fulltext.search(None, routed, top=most, indexed=store.table("chunk_terms"), groups=translations)
        embedded = cut(embedding.embed(routed.select("query_id", F.lit("").alias("heading"), F.col("question").alias("content")), self.provider), "asked")
        near = retrieval.nearest(store.table("embeddings"), embedded.where("embedding is not null").select("query_id", "embedding"), most, key="chunk_id")
        seeds = cut(graph.matched_entities(store.table("entities").select("id", "name", "name_en"), terms).select("query_id", "id"), "seeds")
        # questions for everything also take the entities one step away
        wide = graph.neighbours(seeds.join(routed.where("synthesis").select("query_id"), "query_id", "left_semi"), store.table("relationships"))
        by_graph = graph.search_chunks(seeds.unionByName(wide), store.table("entity_chunks"), store.table("relationships"), top=most)
        leg = lambda df, name: df.select("query_id", "chunk_id", F.lit(name).alias("leg"), "rank")
        return routed, leg(near, "vector").unionByName(leg(fts, "fts")).unionByName(leg(by_graph, "graph")), embedded.where("error is not null").select("query_id", "error")

    def search(self, questions: DataFrame) -> DataFrame:
        """(query_id, chunk_id, score, methods, ranks, rank): three legs and fusion for every question. ``questions``: query_id, question and options."""
        routed, legs, _ = self._legs(questions)
        return retrieval.fuse(legs, routed)

    def traced(self, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(the results of ``search``, a trace of every question): results a leg and fused, weights, identifiers, synthesis, and the error of a leg that others stood in for."""
        routed, legs, failed = self._legs(questions)
        legs = cut(legs, "legs")
        fused = cut(retrieval.fuse(legs, routed), "fused")
        return fused, retrieval.trace(routed, legs, fused, failed)

    def sources_of(self, hits: DataFrame) -> DataFrame:
        """(query_id, sources): what was found, with its documents, in rank order."""
        store = self._open()
        chunks = store.table("chunks").select(F.col("id").alias("chunk_id"), "document_id", "content", "heading", "chunk_type", "page_number", "position_in_doc", F.coalesce("metadata", F.lit("{}")).alias("chunk_metadata"))
        docs = store.table("documents").select(F.col("id").alias("document_id"), "filename", "path", F.coalesce(F.to_json("metadata"), F.lit("{}")).alias("doc_metadata"))
        rows = hits.join(chunks, "chunk_id").join(docs, "document_id")
        one = F.struct("rank", "score", "chunk_id", "document_id", "filename", "path", F.coalesce("heading", F.lit("")).alias("heading"), "content", F.coalesce("chunk_type", F.lit("")).alias("chunk_type"), F.coalesce("page_number", F.lit(0)).alias("page_number"), "position_in_doc", "methods", "chunk_metadata", "doc_metadata")
        sorted_ = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("s"))
        read = lambda x, c: F.from_json(x[c], "map<string,string>")
        return sorted_.select("query_id", F.transform("s", lambda x: x.withField("chunk_metadata", read(x, "chunk_metadata")).withField("doc_metadata", read(x, "doc_metadata"))).alias("sources"))

    def query(self, questions: DataFrame, rounds: int | None = None, structured: bool = False, log: bool = True) -> DataFrame:
        """(query_id, question, answer, confidence, rounds_used, sources, snippets, …) of every question; one without results has no answer."""
        hits = cut(self.search(questions), "hits")
        given = cut(questions.select("query_id", "question").join(self.sources_of(hits), "query_id"), "given")
        _, rounds = self.config.bounded(None, rounds)
        out = reasoning.reason(given, self.provider, rounds, self.config.confidence_threshold)
        out = self._follow_up(questions, hits, cut(out.select("query_id", "question", "answer", "tokens", "confidence", "rounds_used", "sources"), "answers"), rounds)
        words = T.answer_words(F.col("answer"))
        out = out.withColumn("snippets", evaluation.snippets(F.col("sources.content"), words))
        if structured:
            out = reasoning.structured(out, self.provider)
        out = cut(questions.select("query_id", "question").join(out.drop("question"), "query_id", "left"), "queried")
        if log:
            found = F.to_json(F.transform("sources", lambda s: F.struct(s["chunk_id"].alias("chunk_id"), s["score"].alias("score"))))
            # what the provider counted, else an estimate
            tokens = F.coalesce("tokens", T.token_estimate(T.n_words(F.concat_ws(" ", "question", "answer"))))
            self._open().append("query_log", out.select(F.current_timestamp().alias("asked_at"), "question", "answer", "confidence", F.col("rounds_used").alias("rounds"), found.alias("sources"), tokens.alias("tokens")))
        return out

    def _follow_up(self, questions: DataFrame, hits: DataFrame, answered: DataFrame, rounds: int) -> DataFrame:
        """Questions for everything whose window is full and whose answer names what its sources lack are searched and answered once more."""
        routed = retrieval.route(questions).where("synthesis").select("query_id", "max_results")
        full = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).join(routed, "query_id").where("n >= max_results").select("query_id")
        lacking = retrieval.missing_terms(answered.join(full, "query_id", "left_semi").withColumn("corpus", evaluation.corpus(F.col("sources")))).where("size(missing) > 0")
        again = cut(lacking.select("query_id", "question", F.array_join(F.transform("missing", lambda m: F.replace(m, F.lit("-"), F.lit(" "))), " OR ").alias("wanted")), "follow-up")
        if again.isEmpty():
            return answered
        asked = again.select("query_id", F.col("wanted").alias("question"), F.lit(0.5).alias("weight_vec"), F.lit(2.0).alias("weight_fts"), F.lit(1.0).alias("weight_graph"), F.lit(15).alias("max_results"))
        merged = retrieval.merge_followup(hits.join(again.select("query_id"), "query_id", "left_semi"), self.search(asked))
        given = again.select("query_id", "question").join(self.sources_of(merged), "query_id")
        better = reasoning.reason(given, self.provider, rounds, self.config.confidence_threshold).select(*answered.columns)
        return answered.join(again.select("query_id"), "query_id", "left_anti").unionByName(better)

    # -------------------------------------------------------------------------------------------- life

    def _open(self) -> S.Store:
        if self.store is None:
            raise errors.Closed("the engine was closed")
        return self.store

    def close(self) -> None:
        self.store = None
