"""Answers against their sources: validation, confidence, evaluation metrics and reports, with SQL where there is any.

Every user's turn is a question, the assistant's reply an answer (with a reference, or a hedge, added by turns), three documents are its sources.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmere.functions import text as T
from quillmere.operators import evaluation as E
from quillmere.operators import reasoning, retrieval
from quillmere.plans import duck as D
from quillmere.plans.registry import query, table
from quillmere.plans.search_queries import _BM25, benchmark_questions, top_sql
from quillmere.sources.providers import Deterministic

CITE, HEDGE = " (according to {}, page 3, section 2. It is usually so.)", " That might be unclear; in general, 17.5 of 99."

_ANSWERS = f"""d AS (SELECT doc_id, struct_pack(filename := source || '.pdf', heading := {D.trim("string_split(text, chr(10))[1]")}, content := text, page_number := (doc_id % 10)::INT, chunk_id := doc_id) AS s, lang FROM documents),
p AS (SELECT u.conv_id, u.conv_id * 1000 + u.turn AS query_id, u.text AS question, a.text AS reply FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
src AS (SELECT query_id, list(s ORDER BY d.doc_id) AS sources, arg_min(lang, d.doc_id) AS category FROM p JOIN d ON d.doc_id BETWEEN p.conv_id AND p.conv_id + 2 GROUP BY 1),
ans AS (SELECT p.query_id, question, sources, category, reply || CASE WHEN conv_id % 2 = 0 THEN replace('{CITE}', '{{}}', sources[1].filename) ELSE '{HEDGE}' END AS answer,
 [array_to_string({D.fields('reply')}[1:2], ' ') || '|zzz', {D.sentences('question')}[1], 'Section 2', 'page-3|nothing'] AS facts FROM p JOIN src USING (query_id)),
base AS (SELECT *, lower(answer) AS low, lower(array_to_string(list_transform(sources, lambda s: s.content || ' ' || s.heading || ' '), '')) AS corpus FROM ans)"""


def answers(spark, sf):
    docs = table(spark, sf, "documents")
    d = docs.select("doc_id", F.struct(F.concat("source", F.lit(".pdf")).alias("filename"), T.trimmed(F.element_at(F.split("text", "\n"), 1)).alias("heading"), F.col("text").alias("content"), (F.col("doc_id") % 10).cast("int").alias("page_number"), F.col("doc_id").alias("chunk_id"), F.lit("paragraph").alias("chunk_type")).alias("s"), "lang")
    turns = table(spark, sf, "conversations")
    u = turns.where("role = 'user'").select("conv_id", F.col("turn").alias("t"), F.col("text").alias("question"))
    a = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("t"), F.col("text").alias("reply"))
    p = u.join(a, ["conv_id", "t"]).withColumn("query_id", F.col("conv_id") * 1000 + F.col("t"))
    # three keys a question, so that the documents meet them by an equi-join
    src = p.select("query_id", F.explode(F.sequence(F.col("conv_id"), F.col("conv_id") + 2)).alias("doc_id")).join(d, "doc_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "s"))).alias("x"), F.min_by("lang", "doc_id").alias("category"))
    rows = p.join(src, "query_id").withColumn("sources", F.transform("x", lambda x: x["s"]))
    cite = F.concat(F.lit(CITE.split("{}")[0]), F.element_at("sources", 1)["filename"], F.lit(CITE.split("{}")[1]))
    facts = F.array(F.concat(F.concat_ws(" ", F.slice(T.fields(F.col("reply")), 1, 2)), F.lit("|zzz")), F.try_element_at(T.sentences(F.col("question")), F.lit(1)), F.lit("Section 2"), F.lit("page-3|nothing"))
    return rows.select("query_id", "question", F.concat("reply", F.when(F.col("conv_id") % 2 == 0, cite).otherwise(F.lit(HEDGE))).alias("answer"), facts.alias("facts"), "sources", "category")


_EDGE = r"""^[.,;:!?"''()\[\]]+|[.,;:!?"''()\[\]]+$"""


def _words(x: str) -> str:
    return f"list_filter(list_transform({D.fields(f'lower({x})')}, lambda w: regexp_replace(w, '{_EDGE}', '', 'g')), lambda w: strlen(w) > 2 AND NOT list_contains({D.lst(T.EVAL_STOPS)}, w))"


def _normal(x: str) -> str:
    return (
        rf"regexp_replace(regexp_replace(regexp_replace({x}, '[\x{{200B}}-\x{{200D}}\x{{FEFF}}]', '', 'g'), '[\x{{2010}}-\x{{2014}}]', '-', 'g'),"
        r" '[ \t\n\r\f\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]', ' ', 'g')"
    )


def _covered(text: str, facts: str) -> str:
    a = _normal(f"lower({D.trim('a')})")
    plain = _normal(f"lower({text})")
    hit = f"({a}) <> '' AND (contains({plain}, {a}) OR contains(replace({plain}, ' ', ''), replace({a}, ' ', '')) OR contains(replace(replace({plain}, ' ', ''), '-', ''), replace(replace({a}, ' ', ''), '-', '')))"
    found = f"len(list_filter({facts}, lambda f: len(list_filter(string_split(f, '|'), lambda a: {hit})) > 0))"
    return f"CASE WHEN ({text}) = '' OR len({facts}) = 0 THEN 0.0::DOUBLE ELSE {D.rounded(f'{found}::DOUBLE / len({facts})')} END"


def _clamp(x: str) -> str:
    return D.rounded(f"greatest(0, least(1, {x}))")


_NUM = f"regexp_extract_all(low, '{D.regex(E.NUMBERS)}')"
_NAMED = "len(list_filter(sources, lambda s: s.filename <> '' AND contains(low, lower(s.filename))))"
_REFS = "list_sum(list_transform(sources, lambda s: contains(low, lower(s.filename))::INT + (s.heading <> '' AND contains(low, lower(s.heading)))::INT))"
_TERMS = f"list_distinct(list_concat({_words('low')}, {_NUM}))"
_NUMS = f"list_filter({_NUM}, lambda n: NOT regexp_matches(n, '^([0-9]|10)$'))"
_LONG = f"list_filter({_words('low')}, lambda w: strlen(w) > 5)"
_MISSING = "len(list_filter({}, lambda w: NOT contains(corpus, w)))"
_RELEVANT = f"len(list_filter(sources, lambda s: len(list_filter(qw, lambda w: contains(lower(s.content || ' ' || s.heading), w)))::DOUBLE / len(qw) >= 0.3))"
_SCORED = f"""{_ANSWERS}, w AS (SELECT *, {_words('question')} AS qw, {_NUMS} AS nums, {_LONG} AS long, {_TERMS} AS terms FROM base),
scored AS (SELECT query_id, category, {_clamp(f"1 - 0.2::DOUBLE * {D.count_of('low', T.OUTSIDE)} + 0.1::DOUBLE * least({_NAMED}, 3)")} AS faithfulness,
 CASE WHEN len(qw) = 0 THEN 0.5::DOUBLE ELSE {D.rounded(f'{_RELEVANT}::DOUBLE / len(sources)')} END AS relevance, {_covered('answer', 'facts')} AS accuracy, {_covered('corpus', 'facts')} AS context_recall,
 {_clamp(f"0.5::DOUBLE + 0.1::DOUBLE * least({D.count_of('low', T.CITATION_WORDS)}, 3) + 0.1::DOUBLE * ({_NAMED} > 0)::INT")} AS citation_quality,
 CASE WHEN len(terms) = 0 THEN 1.0::DOUBLE ELSE {D.rounded("len(list_filter(terms, lambda w: contains(corpus, w)))::DOUBLE / len(terms)")} END AS claim_grounding,
 CASE WHEN len(nums) + len(long) = 0 THEN 1.0::DOUBLE ELSE {_clamp(f"1 - ({_MISSING.format('nums')} + 0.5::DOUBLE * {_MISSING.format('long')}) / (len(nums) + 0.5::DOUBLE * len(long))")} END AS hallucination,
 {_clamp(f"0.5::DOUBLE + 0.2::DOUBLE * least({_REFS}, 3) / 3 - 0.1::DOUBLE * {D.count_of('low', T.HEDGES)}")} AS confidence FROM w),
evaluated AS (SELECT *, accuracy >= 0.5 AND context_recall >= 0.5 AS passed FROM scored)"""
METRICS = ["faithfulness", "relevance", "accuracy", "context_recall", "citation_quality", "claim_grounding", "hallucination", "confidence"]


@query(f"WITH {_SCORED} SELECT * FROM evaluated")
def evaluate_answers(spark, sf):
    """Every metric of every answer."""
    return E.score(answers(spark, sf)).select("query_id", "category", *METRICS, "passed")


@query(f"WITH {_SCORED} SELECT category, count(*) AS tests, sum(passed::INT)::BIGINT AS passed, {', '.join(f'{D.rounded(f'avg({m})')} AS {m}' for m in METRICS)} FROM evaluated GROUP BY GROUPING SETS ((), (category))")
def category_report(spark, sf):
    return E.report(E.score(answers(spark, sf)), METRICS)


_PIECES = f"list_transform(string_split(answer, '.'), lambda p: {D.trim('p')})"
_MADE_UP = f"list_filter({_PIECES}, lambda p: {D.any_of('lower(p)', ['according to', 'as stated in'])} AND len(list_filter(sources, lambda s: s.filename <> '' AND contains(lower(p), lower(s.filename)))) = 0 AND {D.any_of('lower(p)', ['document', 'report'])})"


@query(f"""
WITH {_ANSWERS}, i AS (SELECT query_id, (len(sources) > 0 AND {_REFS} = 0)::INT + len({_MADE_UP}) AS citation_issues, {D.count_of('low', T.NEGATIONS)} + {D.any_of('low', T.EXTERNAL)}::INT AS consistency_issues FROM base)
SELECT query_id, citation_issues::INT AS citation_issues, consistency_issues::INT AS consistency_issues, {D.rounded('greatest(0, 1 - 0.15::DOUBLE * citation_issues - 0.2::DOUBLE * consistency_issues)')} AS validation_confidence FROM i
""")
def validate_answers(spark, sf):
    made = E.validate(answers(spark, sf))
    return made.select("query_id", F.size("citation_issues").alias("citation_issues"), F.size("consistency_issues").alias("consistency_issues"), "validation_confidence")


@query(f"SELECT conv_id, turn, NOT {D.any_of('lower(text)', T.NOT_FOUND)} AS found FROM conversations")
def found_answers(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", E.found(F.col("text")).alias("found"))


def _cited(p: str) -> str:
    return f"list_transform(range(1, len(regexp_extract_all(answer, '{p}', 0)) + 1), lambda i: struct_pack(t := {D.trim(f"regexp_extract_all(answer, '{p}', 0)[i]")}, r := regexp_extract_all(answer, '{p}', 1)[i]))"


_BY = "list_filter(sources, lambda s: {})[1].chunk_id"
_NUMBER = "TRY_CAST(regexp_extract(c.r, '^(\\d{1,9})', 1) AS INT)"
_MATCH = f"""coalesce({_BY.format("contains(lower(s.filename), lower(c.r))")}, {_BY.format("s.heading <> '' AND contains(lower(s.heading), lower(c.r))")}, {_BY.format(f"{_NUMBER} > 0 AND s.page_number = {_NUMBER}")},
 CASE WHEN {_NUMBER} > 0 AND {_NUMBER} <= len(sources) THEN sources[{_NUMBER}].chunk_id END)"""
_USED = f"(s.filename <> '' AND contains(low, lower(s.filename))) OR (s.heading <> '' AND contains(low, lower(s.heading))) OR (len({D.fields('s.content')}) > 5 AND contains(low, lower(array_to_string({D.fields('s.content')}[1:5], ' '))))"
_LENGTH = "CASE WHEN w < 10 THEN 0.2::DOUBLE WHEN w < 30 THEN 0.5::DOUBLE WHEN w < 100 THEN 0.8::DOUBLE WHEN w < 500 THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END"
_STEADY = f"greatest(0, 1 - 0.15::DOUBLE * {D.count_of('low', T.CONTRADICTIONS)} - 0.2::DOUBLE * {D.count_of('low', T.UNCERTAIN)})"
_COMPOSITE = f"0.3::DOUBLE * (len(list_filter(sources[1:5], lambda s: {_USED}))::DOUBLE / len(sources[1:5])) + 0.3::DOUBLE * CASE WHEN n = 0 THEN 0.5::DOUBLE ELSE v::DOUBLE / n END + 0.25::DOUBLE * {_STEADY} + 0.15::DOUBLE * {_LENGTH}"


@query(f"""
WITH {_ANSWERS}, c1 AS (SELECT *, list_concat({', '.join(_cited(p) for p in E.CITED)}) AS found FROM base),
c2 AS (SELECT *, list_filter(found, lambda c, i: list_position(list_transform(found, lambda x: x.t), c.t) = i) AS once FROM c1),
c3 AS (SELECT *, len(once) AS n, len(list_filter(once, lambda c: {_MATCH} IS NOT NULL)) AS v, {D.n_words('answer')} AS w FROM c2)
SELECT query_id, {_clamp(_COMPOSITE)} AS confidence, n::INT AS citations, v::INT AS verified FROM c3
""")
def composite_confidence(spark, sf):
    """Confidence from coverage, citations, consistency and length, with the numbers of citations and of verified ones."""
    made = answers(spark, sf).select("query_id", E.composite_confidence(F.col("answer"), F.col("sources")).alias("confidence"), E.citations(F.col("answer"), F.col("sources")).alias("c"))
    return made.select("query_id", "confidence", F.size("c").alias("citations"), F.size(F.filter("c", lambda c: c["verified"])).alias("verified"))


def _answer_words(x: str) -> str:
    return rf"list_distinct(list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{Nd}}]+'), lambda w: strlen(w) >= 4 AND NOT list_contains({D.lst(T.SNIPPET_STOPS)}, w)))"


@query(f"""
WITH {_ANSWERS}, a AS (SELECT query_id, {_answer_words('answer')} AS words, unnest(sources) AS s, generate_subscripts(sources, 1) - 1 AS rank FROM ans),
b AS (SELECT query_id, rank, s.chunk_id AS chunk_id, words, {D.sentences('s.content')} AS ss FROM a), c AS (SELECT *, list_transform(ss, lambda x: len(list_intersect({_answer_words('x')}, words))) AS sc FROM b),
e AS (SELECT *, coalesce(list_max(sc), 0) AS top, list_position(sc, list_max(sc)) AS i FROM c), f AS (SELECT *, ss[i] AS own, coalesce(sc[i + 1], 0) AS after, CASE WHEN i > 1 THEN sc[i - 1] ELSE 0 END AS before FROM e),
g AS (SELECT *, CASE WHEN after >= before AND after > 0 THEN own || ' ' || ss[i + 1] WHEN before > 0 THEN ss[i - 1] || ' ' || own END AS pair FROM f)
SELECT query_id, rank::INT AS rank, chunk_id, CASE WHEN top = 0 THEN '' WHEN strlen(own) < 300 AND strlen(pair) <= 300 THEN pair ELSE own END AS snippet FROM g
""")
def snippets(spark, sf):
    """The part of every source that its answer is from."""
    own = answers(spark, sf).select("query_id", "sources", T.answer_words(F.col("answer")).alias("words"))
    made = own.select("query_id", F.col("sources.chunk_id").alias("chunk_id"), E.snippets(F.col("sources.content"), F.col("words")).alias("snippet"))
    return made.select("query_id", F.posexplode(F.arrays_zip("chunk_id", "snippet")).alias("rank", "s")).select("query_id", "rank", "s.chunk_id", "s.snippet")


@query()
def reason(spark, sf):
    """Answer, validate, refine, for all questions at once, with the offline provider."""
    return reasoning.reason(answers(spark, sf).select("query_id", "question", "sources"), Deterministic()).select("query_id", "answer", "confidence", "rounds_used")


@query()
def judged_accuracy(spark, sf):
    """Accuracy by a judging model; where its reply is unusable, strict accuracy."""
    return reasoning.judge(answers(spark, sf), Deterministic()).select("query_id", "judged")


@query()
def structured_answers(spark, sf):
    return reasoning.structured(answers(spark, sf).select("query_id", "answer"), Deterministic()).select("query_id", "found", "response")


_RETRIEVED = f"""chunks AS (SELECT doc_id AS chunk_id, text AS content FROM documents), q AS (SELECT item_id AS query_id, text AS question FROM benchmark), {_BM25},
 hit AS ({top_sql('hits', 64)}), sen AS (SELECT query_id, {D.sentences('question')} AS ss FROM q)"""


def retrieved(spark, sf, k: int = 64):
    docs = table(spark, sf, "documents")
    return retrieval.bm25(docs.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")), benchmark_questions(spark, sf), top=k)


def _sentences(spark, sf):
    return benchmark_questions(spark, sf).select("query_id", "question", T.sentences(F.col("question")).alias("ss"))


@query(f"""
WITH {_RETRIEVED}, truth AS (SELECT query_id, i AS span_id, ss[i] AS span, 'src' || query_id % 5 || '.pdf' AS path FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS i FROM sen)),
ks(k) AS (VALUES {', '.join(f'({k})' for k in E.KS)}),
x AS (SELECT h.query_id, h.rank, t.span_id, lower(d.text) AS low, lower(t.span) AS want, {D.fields('lower(t.span)')} AS ws, lower(d.source || '.pdf') = lower(t.path) AS same FROM hit h JOIN documents d ON d.doc_id = h.chunk_id JOIN truth t ON t.query_id = h.query_id),
pair AS (SELECT query_id, rank, span_id, contains(low, want) OR (same AND len(list_filter(ws, lambda w: strlen(w) > 3 AND contains(low, w)))::DOUBLE / greatest(len(ws), 1) > 0.5) AS hit FROM x),
pr AS (SELECT query_id, k, avg(h::INT) AS precision FROM (SELECT query_id, rank, bool_or(hit) AS h FROM pair GROUP BY ALL) JOIN ks ON rank <= k GROUP BY ALL),
first AS (SELECT query_id, span_id, min(rank) AS first FROM pair WHERE hit GROUP BY ALL),
re AS (SELECT t.query_id, k, avg(coalesce(first <= k, false)::INT) AS recall FROM truth t CROSS JOIN ks LEFT JOIN first f ON f.query_id = t.query_id AND f.span_id = t.span_id GROUP BY ALL)
SELECT re.query_id, re.k, {D.rounded('coalesce(precision, 0)')} AS precision, {D.rounded('recall')} AS recall FROM re LEFT JOIN pr ON pr.query_id = re.query_id AND pr.k = re.k
""")
def precision_recall_at_k(spark, sf):
    """Sentences of a benchmark item as spans to be found."""
    docs = table(spark, sf, "documents")
    got = retrieved(spark, sf).join(docs, F.col("doc_id") == F.col("chunk_id")).select("query_id", "rank", F.col("text").alias("content"), F.concat("source", F.lit(".pdf")).alias("filename"))
    truth = _sentences(spark, sf).select("query_id", F.posexplode("ss").alias("span_id", "span"), F.concat(F.lit("src"), (F.col("query_id") % 5).cast("string"), F.lit(".pdf")).alias("path"))
    return E.at_k(got, truth)


_DIAGNOSED = f"""{_RETRIEVED}, f AS (SELECT query_id, unnest(ss) AS fact, CASE WHEN query_id % 2 = 0 THEN ss[1] ELSE '' END AS answer FROM sen),
holds AS (SELECT low, min(doc_id) AS chunk_id FROM (SELECT DISTINCT lower(fact) AS low FROM f) JOIN documents ON contains(lower(text), low) GROUP BY 1),
diagnosed AS (SELECT f.query_id, fact, h.chunk_id, CASE WHEN h.chunk_id IS NULL THEN 'CHUNK_MISS' WHEN h.chunk_id NOT IN (SELECT vec_id FROM embeddings) THEN 'EMBEDDING_MISS'
 WHEN NOT EXISTS (SELECT 1 FROM hit WHERE hit.query_id = f.query_id AND hit.chunk_id = h.chunk_id AND rank <= 64) THEN 'RETRIEVAL_MISS' WHEN NOT contains(lower(answer), lower(fact)) THEN 'MODEL_MISS' ELSE 'PASS' END AS stage
 FROM f LEFT JOIN holds h ON h.low = lower(fact))"""


def _diagnosed(spark, sf):
    facts = _sentences(spark, sf).select("query_id", F.explode("ss").alias("fact"), F.when(F.col("query_id") % 2 == 0, F.try_element_at("ss", F.lit(1))).otherwise("").alias("answer"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return E.diagnose(facts, docs, table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id")), retrieved(spark, sf))


@query(f"WITH {_DIAGNOSED} SELECT * FROM diagnosed")
def diagnosis(spark, sf):
    """Where each fact got lost: chunking, embedding, retrieval or the model."""
    return _diagnosed(spark, sf)


@query(f"WITH {_DIAGNOSED}, s AS (SELECT query_id, stage, list_position({D.lst(E.STAGES)}, stage) AS severity FROM diagnosed) SELECT query_id, arg_max(stage, severity) AS stage FROM s GROUP BY 1")
def worst_stages(spark, sf):
    return E.worst_stage(_diagnosed(spark, sf))
