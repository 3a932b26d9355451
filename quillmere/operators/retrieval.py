"""Retrieval over batches of questions: routing, inverted index, BM25, exact nearest neighbours, fusion."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from quillmere.functions import text as T
from quillmere.functions.batches import lean, settle
from quillmere.operators import scoring

RRF_K = 60
WINDOW, WIDE_WINDOW = 20, 40
K1, B = scoring.K1, scoring.B
#: A number behind one of these is a place in a document and no identifier.
NUMBERED = "chapter|fig|figure|item|page|part|ref|section|step|table"


def route(queries: DataFrame, vec: float = 1.0, fts: float = 1.0, graph: float = 0.5) -> DataFrame:
    """Adds identifiers, synthesis, weights and max_results to ``queries`` (query_id, question and, if wanted, weights and max_results of their own).

    Identifiers double the full-text weight and halve the vector weight; a question for everything widens the window.  A weight of 0 or null
    is the default.
    """
    own = lambda c, d: F.when(F.coalesce(F.col(c), F.lit(0.0)) == 0, F.lit(d)).otherwise(F.col(c).cast("double")) if c in queries.columns else F.lit(d)
    asked = F.when(F.coalesce(F.col("max_results"), F.lit(0)) == 0, WINDOW).otherwise(F.col("max_results")) if "max_results" in queries.columns else F.lit(WINDOW)
    flagged = queries.withColumn("identifiers", T.has_identifier(F.col("question"))).withColumn("synthesis", T.is_exhaustive(F.col("question")))
    return flagged.withColumns(
        {
            "weight_vec": own("weight_vec", vec) * F.when(F.col("identifiers"), 0.5).otherwise(1.0),
            "weight_fts": own("weight_fts", fts) * F.when(F.col("identifiers"), 2.0).otherwise(1.0),
            "weight_graph": own("weight_graph", graph),
            "max_results": F.when(F.col("synthesis"), F.greatest(asked, F.lit(WIDE_WINDOW))).otherwise(asked),
        }
    )


#: Between two index terms.
SEPARATORS = r"[^\p{L}\p{Nd}]+"


def terms(text: Column) -> Column:
    """Index terms: lower case, runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), SEPARATORS), "")


def postings(chunks: DataFrame, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """(key, term, tf): one exchange, of texts; a chunk's terms are counted in one pass over it, and rows of one key are one chunk."""
    settle(chunks.sparkSession)

    def run(batches):
        last, counts, seen = None, None, False
        keys, sizes, words, times = [], [], [], []

        def close():
            keys.append(last)
            sizes.append(len(counts))
            words.extend(counts.keys())
            times.extend(counts.values())

        def out(kind):
            made = pa.array(keys, kind).take(pa.array(np.repeat(np.arange(len(keys)), sizes)))
            batch = pa.RecordBatch.from_arrays([made, pa.array(words, pa.string()), pa.array(times, pa.int64())], names=[key, "term", "tf"])
            for x in (keys, sizes, words, times):
                x.clear()
            return batch

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = scoring.cut_words(t or "")
                if seen and k == last:
                    counts.update(found)
                    continue
                if seen:
                    close()
                    if len(words) > 1 << 16:
                        yield out(batch.schema.types[0])
                last, counts, seen = k, Counter(found), True
            if words:
                yield out(batch.schema.types[0])
        if seen:
            close()
            yield out(batch.schema.types[0])

    schema = Ty.StructType([chunks.schema[key], Ty.StructField("term", Ty.StringType()), Ty.StructField("tf", Ty.LongType())])
    sorted_ = chunks.select(key, F.lower(text).alias("q_low")).repartition(F.col(key)).sortWithinPartitions(key)
    return sorted_.mapInArrow(lean(run), schema)


def lengths(chunks: DataFrame, key: str = "chunk_id", text: str = "content") -> DataFrame:
    return chunks.select(key, F.size(terms(F.col(text))).cast("bigint").alias("dl"))


def positions(chunks: DataFrame, key: str = "chunk_id", text: str = "content") -> DataFrame:
    return chunks.select(key, F.posexplode(terms(F.col(text))).alias("pos", "term"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term): distinct terms that matter."""
    found = F.array_distinct(F.filter(terms(F.col("question")), lambda w: (F.octet_length(w) > 2) & ~F.array_contains(T.literals(T.RETRIEVAL_STOPS), w)))
    return queries.select("query_id", F.explode(found).alias("term"))


def bm25(chunks: DataFrame, queries: DataFrame, top: int | None = None, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """(query_id, key, score, matched, rank): BM25 over one text column, all questions at once.

    Only postings of asked terms are formed.  As long as the questions have at most ``scoring.BOUND`` terms, texts are read once by Python workers that know them, and a
    chunk's scores add up in its own task, where with ``top`` the best are chosen.  Beyond that the corpus is exploded, filtered by a semi-join on the terms of the
    questions, and shuffled once, by chunk; N and the mean length come from one more aggregate that keeps no term.
    """
    asked = query_terms(queries)
    held = asked.limit(scoring.BOUND + 1).collect()
    if len(held) <= scoring.BOUND:
        number: dict[str, int] = {}
        pairs = [(r["query_id"], number.setdefault(r["term"], len(number))) for r in held]
        packed = scoring.pack(chunks.select(key, F.lower(text).alias("q_low")), key, "q_low", scoring.words(number))
        return ranked(scoring.best(packed, pairs, queries.schema["query_id"].dataType, key, top), "score", key, top)
    return ranked(score_postings(asked_postings(chunks, asked, key, text), lengths(chunks, key, text), asked, key), "score", key, top)


def tokenised(chunks: DataFrame, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """(key, dl, ts): the terms of every chunk and their number.

    ``ts`` is a column of its own below ``dl``: it is used twice, so the optimizer keeps it apart and a text is cut once.
    """
    return chunks.select(key, terms(F.col(text)).alias("ts")).select(key, F.size("ts").cast("bigint").alias("dl"), "ts")


def asked_postings(chunks: DataFrame, asked: DataFrame, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """(term, key, dl, tf) of the asked terms only, all of a chunk in one task."""
    # the outer form infers no filter on the array, which would cut every text a second time
    exploded = tokenised(chunks, key, text).select(key, "dl", F.explode_outer("ts").alias("term"))
    hit = exploded.join(asked.select("term").distinct(), "term", "left_semi")
    return hit.repartition(F.col(key)).groupBy("term", key, "dl").agg(F.count(F.lit(1)).alias("tf"))


def score_postings(posts: DataFrame, sizes: DataFrame, asked: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(query_id, key, score, matched). ``posts``: term, key, dl, tf, partitioned by chunk, so that scores add up where they are; ``sizes``: dl of every chunk."""
    # names every column, so that both uses of the postings are one exchange
    df = posts.groupBy("term").agg(F.count(F.when(F.col(key).isNotNull() & (F.col("tf") > 0) & (F.col("dl") > 0), 1)).alias("df"))
    stats = sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    scored = posts.join(df.join(asked, "term"), "term").crossJoin(F.broadcast(stats))  # stats is one row
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return scored.groupBy("query_id", key).agg(F.round(F.sum(part), 6).alias("score"), F.count(F.lit(1)).alias("matched"))


def ranked(hits: DataFrame, score: str, key: str, top: int | None = None) -> DataFrame:
    """Adds rank by score, greatest first, then key, per query."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(score), key))
    out = hits.withColumn("rank", rank)
    if top is not None:
        out = out.where(F.col("rank") <= top)
    return out.withColumn("rank", F.col("rank").cast("bigint"))


def _distances(metric: str, q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Distances of rows of ``q`` to rows of ``d``, pair by pair."""
    if metric == "dot":
        return -(q * d).sum(1)
    if metric == "cosine":
        return 1 - (q * d).sum(1) / np.maximum(np.linalg.norm(q, axis=1) * np.linalg.norm(d, axis=1), 1e-300)
    # differences, not the expanded square: equal vectors are at exactly 0
    return np.sqrt(((q - d) ** 2).sum(1))


#: Rows of vectors at once: of those asked for, of those searched.
ASKED_ROWS, SEARCHED_ROWS = 256, 4096


def _searched(metric: str, q: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, slack): the greater a @ b.T, the nearer, for the rows of each of ``q``; ``slack`` bounds how far a score may be off, with its distance's rounding to 6 digits, for each of ``q``.

    Single precision, unless values are too large or small for it.
    """
    norm = lambda x: np.sqrt((x * x).sum(1))
    n_q, n_d = norm(q), norm(d)
    if metric == "cosine":
        d = d / np.maximum(n_d, 1e-300)[:, None]
        q = q / np.maximum(n_q, 1e-300)[:, None]
        n_q, n_d = norm(q), norm(d)
    a, b = (np.c_[2 * q, np.ones(len(q))], np.c_[d, -(n_d * n_d)]) if metric == "l2" else (q, d)
    most = n_d.max(initial=0)
    whole = 2 * n_q * most + most * most if metric == "l2" else n_q * most
    plain = most < 1e15 and n_q.max(initial=0) < 1e15
    step = 2.0**-23 if plain else 2.0**-52
    # a distance off by 1e-6 is a square off by 2e-6 distances, each at most the sum of both lengths
    slack = whole * step * (q.shape[1] + 8) + (4e-6 * (n_q + most + 1) if metric == "l2" else 4e-6) + (1e-30 if plain else 0)
    kind = np.float32 if plain else np.float64
    return np.ascontiguousarray(a, kind), np.ascontiguousarray(b, kind), slack


def below(limit: np.ndarray, kind) -> np.ndarray:
    """``limit`` in a type of fewer digits, not above it."""
    got = limit.astype(kind)
    return np.where(got > limit, np.nextafter(got, np.array(-np.inf, kind)), got)


def _candidates(a: np.ndarray, b: np.ndarray, slack: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of a, row of b) of all pairs that may be among the k best of a row: products piece by piece, of which only those above the k-th score so far are kept."""
    limit = np.full(len(a), -np.inf)
    rows, cols, scores = [], [], []

    def tighten() -> None:
        i, j, x = (np.concatenate(v) for v in (rows, cols, scores))
        order = np.lexsort((-x, i))
        i, j, x = i[order], j[order], x[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i, side="left")
        last = nth == k - 1
        limit[i[last]] = x[last] - 2 * slack[i[last]]
        good = x >= limit[i]
        rows[:], cols[:], scores[:] = [i[good]], [j[good]], [x[good]]

    for s in range(0, len(b), SEARCHED_ROWS):
        dots = a @ b[s : s + SEARCHED_ROWS].T
        if not s and k < dots.shape[1]:
            limit[:] = np.partition(dots, dots.shape[1] - k, axis=1)[:, dots.shape[1] - k] - 2 * slack
        i, j = np.divmod(np.flatnonzero(dots >= below(limit, dots.dtype)[:, None]), dots.shape[1])
        rows.append(i)
        cols.append(j + s)
        scores.append(dots[i, j].astype(np.float64))
        if sum(map(len, rows)) > 1 << 17:
            tighten()
    tighten()
    return rows[0], cols[0]


def nearest(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2", key: str = "vec_id", vector: str = "embedding", block: int = 1 << 15, exclude_self: bool = False) -> DataFrame:
    """(query_id, key, distance, rank): the exact k nearest vectors of every query.

    Both sides are cut into blocks by a hash; each pair of blocks is a matrix product in numpy, made piece by piece, that keeps k a query, and a window
    merges the survivors.  No side is broadcast; every task holds two blocks.  A vector is sent once for every block of the other side, so blocks are large, but for
    small tables, of which every core has some pairs.  ``queries``: query_id and the vector column.
    """
    n_d, n_q = vectors.count(), queries.count()
    share = max(1, round((4 * vectors.sparkSession.sparkContext.defaultParallelism) ** 0.5))
    blocks_d, blocks_q = (max(1, -(-n // block), min(share, -(-n // 1024))) for n in (n_d, n_q))
    if metric not in ("l2", "cosine", "dot"):
        raise ValueError(f"no metric {metric!r}")
    side_d = vectors.where(F.col(vector).isNotNull()).select(F.pmod(F.xxhash64(key), F.lit(blocks_d).cast("bigint")).alias("bd"), F.col(key).alias("id"), F.col(vector).alias("v")).withColumn("bq", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks_q - 1).cast("bigint"))))
    side_q = queries.where(F.col(vector).isNotNull()).select(F.pmod(F.xxhash64("query_id"), F.lit(blocks_q).cast("bigint")).alias("bq"), F.col("query_id").alias("id"), F.col(vector).alias("v")).withColumn("bd", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks_d - 1).cast("bigint"))))

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        qi, di = right["id"].to_numpy(), left["id"].to_numpy()
        # the values, not the raw child: a list column may be sliced
        grid = lambda t: np.array(t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(t), -1)
        out_q, out_d, out_x = [], [], []
        if len(qi) and len(di):
            data, asked = grid(left), grid(right)
            # without vectors that have no distance to any other
            good_d, good_q = np.isfinite(data).all(1), np.isfinite(asked).all(1)
            data, di, asked, qi = data[good_d], di[good_d], asked[good_q], qi[good_q]
            a, b, slack = _searched(metric, asked, data)
            own = int(np.unique(di, return_counts=True)[1].max(initial=0)) if exclude_self else 0  # so many rows may be a query's own
            for s in range(0, len(qi) if len(di) else 0, ASKED_ROWS):
                ids, part = qi[s : s + ASKED_ROWS], asked[s : s + ASKED_ROWS]
                i, j = _candidates(a[s : s + ASKED_ROWS], b, slack[s : s + ASKED_ROWS], k + own)
                if exclude_self:
                    other = ids[i] != di[j]
                    i, j = i[other], j[other]
                x = np.round(_distances(metric, part[i], data[j]), 6) + 0.0
                finite = np.isfinite(x)
                i, j, x = i[finite], j[finite], x[finite]
                order = np.lexsort((di[j], x, i))
                i, j, x = i[order], j[order], x[order]
                first = np.arange(len(i)) - np.searchsorted(i, i, side="left") < k
                out_q.append(ids[i[first]])
                out_d.append(di[j[first]])
                out_x.append(x[first])
        cat = lambda xs, t: pa.array(np.concatenate(xs) if xs else np.zeros(0), t)
        return pa.table({"query_id": cat(out_q, pa.int64()), key: cat(out_d, pa.int64()), "distance": cat(out_x, pa.float64())})

    hits = side_d.groupBy("bd", "bq").cogroup(side_q.groupBy("bd", "bq")).applyInArrow(pair, f"query_id bigint, {key} bigint, distance double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", key))
    return hits.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k)


def fuse(legs: DataFrame, weights: DataFrame | None = None, top: int | None = None, key: str = "chunk_id") -> DataFrame:
    """Weighted reciprocal rank fusion: (query_id, key, score, methods, vec_rank, fts_rank, graph_rank, rank).

    ``legs``: query_id, key, leg (vector, fts, graph) and rank from 1; the union of any legs, fused by one aggregation.  ``weights``: query_id,
    weight_vec, weight_fts, weight_graph and, if wanted, max_results.
    """
    if weights is None:
        weighted = legs.withColumns({"weight_vec": F.lit(1.0), "weight_fts": F.lit(1.0), "weight_graph": F.lit(0.5), "max_results": F.lit(None).cast("int")})
    else:
        weighted = legs.join(weights.select("query_id", "weight_vec", "weight_fts", "weight_graph", "max_results"), "query_id")
    weight = F.when(F.col("leg") == "vector", F.col("weight_vec")).when(F.col("leg") == "fts", F.col("weight_fts")).otherwise(F.col("weight_graph"))
    at = lambda leg: F.min(F.when(F.col("leg") == leg, F.col("rank")))
    made = weighted.groupBy("query_id", key).agg(F.round(F.sum(weight / (RRF_K + F.col("rank"))), 9).alias("score"), at("vector").alias("vec_rank"), at("fts").alias("fts_rank"), at("graph").alias("graph_rank"), F.max("max_results").alias("q_max"))
    named = F.filter(F.array(*[F.when(F.col(f"{c}_rank").isNotNull(), F.lit(n)) for c, n in (("vec", "vector"), ("fts", "fts"), ("graph", "graph"))]), lambda x: x.isNotNull())
    out = made.withColumn("methods", F.concat_ws(",", named)).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), key)))
    limit = F.coalesce(F.col("q_max"), F.lit(top if top is not None else 1 << 30))
    return out.where(F.col("rank") <= limit).withColumn("rank", F.col("rank").cast("bigint")).drop("q_max")


def merge_followup(first: DataFrame, extra: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Results of a follow-up search behind the first ones; what is there already isn't added again."""
    new = extra.join(first.select("query_id", key), ["query_id", key], "left_anti")
    last = first.groupBy("query_id").agg(F.max("rank").alias("q_last"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("rank", key))
    moved = new.withColumn("q_place", place).join(last, "query_id", "left").withColumn("rank", (F.col("q_place") + F.coalesce("q_last", F.lit(0))).cast("bigint")).drop("q_place", "q_last")
    return first.unionByName(moved, allowMissingColumns=True)


def missing_terms(answers: DataFrame, corpus: str = "corpus", answer: str = "answer") -> DataFrame:
    """Adds ``missing``: identifiers of an answer that its sources don't hold, minus those behind words like ``figure``."""
    ids = F.filter(T.identifiers(F.col(answer), T.ANSWER_PATTERNS), lambda s: s != "")
    once = F.filter(ids, lambda s, i: F.array_position(F.transform(ids, F.lower), F.lower(s)) == i + 1)
    low = F.lower(F.col(answer))
    behind = lambda s: F.right(F.split_part(low, F.lower(s), F.lit(1)), F.lit(10))
    return answers.withColumn("missing", F.filter(once, lambda s: ~F.contains(F.lower(F.col(corpus)), F.lower(s)) & ~behind(s).rlike(f"({NUMBERED}) $")))


def trace(routed: DataFrame, legs: DataFrame, fused: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """(query_id, vec_results, fts_results, graph_results, fused_results, identifiers, synthesis, weights, error) of every question of a search, also of one that found nothing."""
    counted = legs.groupBy("query_id").agg(*[F.count_if(F.col("leg") == leg).alias(f"{c}_results") for c, leg in (("vec", "vector"), ("fts", "fts"), ("graph", "graph"))])
    ends = fused.groupBy("query_id").agg(F.count(F.lit(1)).alias("fused_results"))
    out = routed.select("query_id", "identifiers", "synthesis", "weight_vec", "weight_fts", "weight_graph").join(counted, "query_id", "left").join(ends, "query_id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("vec_results", "fts_results", "graph_results", "fused_results")})
    return out.withColumn("error", F.lit(None).cast("string")) if failed is None else out.join(failed.groupBy("query_id").agg(F.min("error").alias("error")), "query_id", "left")
