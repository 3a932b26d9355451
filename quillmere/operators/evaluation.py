"""Answers against their sources: validation, confidence and evaluation metrics.

``answers``: query_id, question, answer, facts array<string>, sources array<struct<filename, heading, content, page_number, chunk_id>> in rank order.
Array functions and aggregates, but for what looks many words up in long texts, which runs in Python workers over batches of bounded size.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from quillmere.functions import text as T
from quillmere.functions.batches import lean, settle
from quillmere.operators import scoring
from quillmere.operators.retrieval import SEPARATORS, asked_postings, terms

NUMBERS = T.B0 + r"[0-9]+(?:\.[0-9]+)?" + T.B1
KS = [1, 4, 8, 16, 32, 64]


def corpus(sources: Column) -> Column:
    """Lower-case contents and headings, one after the other."""
    return F.lower(F.concat_ws("", F.transform(sources, lambda s: F.concat(F.coalesce(s["content"], F.lit("")), F.lit(" "), F.coalesce(s["heading"], F.lit("")), F.lit(" ")))))


def _has(text: Column, part: Column) -> Column:
    return (part != "") & F.contains(text, part)


def _round(x: Column) -> Column:
    return F.round(x.cast("double"), 6)


def faithfulness(answer: Column, sources: Column) -> Column:
    """1 less 0.2 for each phrase of outside knowledge, plus 0.1 for each source named, three at most."""
    low = F.lower(answer)
    named = F.size(F.filter(sources, lambda s: _has(low, F.lower(s["filename"]))))
    return F.when(answer == "", 0.0).otherwise(_round(T.clamp(1 - 0.2 * T.count_of(low, T.OUTSIDE) + 0.1 * F.least(named, F.lit(3)))))


@F.arrow_udf(Ty.ArrayType(Ty.StringType()))
def _words_in(words: pa.Array, text: pa.Array) -> pa.Array:
    """Of the words, those that a text contains."""
    made = []
    for ws, t in zip(words.to_pylist(), text.to_pylist(), strict=True):
        pieces = set((t or "").split(" "))
        once = " ".join(pieces)  # a word without a space is within a piece without one
        made.append([w for w in ws or () if w in pieces or w in (t or "" if " " in w else once)])
    return pa.array(made, pa.list_(pa.string()))


@F.arrow_udf(Ty.ArrayType(Ty.IntegerType()))
def _counts_in(words: pa.Array, texts: pa.Array) -> pa.Array:
    """How many of the words each text contains."""
    made = [[0 if t is None else sum(w in t for w in ws or ()) for t in ts or ()] for ws, ts in zip(words.to_pylist(), texts.to_pylist(), strict=True)]
    return pa.array(made, pa.list_(pa.int32()))


def relevance(question: Column, sources: Column, words: Column | None = None, counts: Column | None = None) -> Column:
    """Share of sources that hold at least 30 % of the question's words. ``words`` and ``counts``: these words, and how many of them each source has, if they are known."""
    if words is not None:
        good = F.size(F.filter(counts, lambda n: n / F.size(words) >= 0.3))
        return F.when(F.size(sources) == 0, 0.0).when(F.size(words) == 0, 0.5).otherwise(_round(good / F.size(sources)))
    low = lambda s: F.lower(F.concat(s["content"], F.lit(" "), s["heading"]))

    def of(words: Column) -> Column:
        good = F.size(F.filter(sources, lambda s: T.let(low(s), lambda text: F.size(F.filter(words, lambda w: F.contains(text, w)))) / F.size(words) >= 0.3))
        return F.when(F.size(words) == 0, 0.5).otherwise(_round(good / F.size(sources)))

    return F.when(F.size(sources) == 0, 0.0).otherwise(T.let(T.evaluation_words(question), of))


def covered(text: Column, facts: Column) -> Column:
    """Share of facts of which an alternative (between bars) is in the text: as it is, without spaces, or without spaces and hyphens."""
    without = lambda x, mark: F.replace(x, F.lit(mark), F.lit(""))

    def of(plain: Column, tight: Column, bare: Column) -> Column:
        def hit(a: Column) -> Column:
            return (a != "") & (F.contains(plain, a) | T.let(without(a, " "), lambda t: F.contains(tight, t) | F.contains(bare, without(t, "-"))))

        found = F.size(F.filter(facts, lambda f: F.exists(F.split(f, "\\|"), lambda a: T.let(T.normal(F.lower(T.trimmed(a))), hit))))
        return _round(found / F.size(facts))

    told = T.let(T.normal(F.lower(text)), lambda plain: T.let(without(plain, " "), lambda tight: T.let(without(tight, "-"), lambda bare: of(plain, tight, bare))))
    return F.when((text == "") | (F.size(facts) == 0), 0.0).otherwise(told)


def accuracy(answer: Column, facts: Column) -> Column:
    return covered(answer, facts)


def context_recall(sources: Column, facts: Column, text: Column | None = None) -> Column:
    """``text``: the corpus of the sources, if it is known."""
    own = lambda x: covered(x, facts)
    return F.when(F.size(sources) == 0, 0.0).otherwise(T.let(corpus(sources), own) if text is None else own(text))


def citation_quality(answer: Column, sources: Column) -> Column:
    low = F.lower(answer)
    named = F.exists(sources, lambda s: _has(low, F.lower(s["filename"])))
    return F.when(answer == "", 0.0).otherwise(_round(T.clamp(0.5 + 0.1 * F.least(T.count_of(low, T.CITATION_WORDS), F.lit(3)) + 0.1 * named.cast("int"))))


def _numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({NUMBERS})"), F.lit(1))


def claims(answer: Column) -> Column:
    """Distinct words and numbers of an answer."""
    low = F.lower(answer)
    return F.array_distinct(F.concat(T.evaluation_words(low), _numbers(low)))


def claim_grounding(answer: Column, sources: Column, text: Column | None = None, terms: Column | None = None, held: Column | None = None) -> Column:
    """Share of the answer's distinct words and numbers that some source holds; 1 if there are none. ``terms`` and ``held``: these, and those that are held, if they are known."""
    if terms is not None:
        return F.when((answer == "") | (F.size(sources) == 0), 0.0).when(F.size(terms) == 0, 1.0).otherwise(_round(F.size(held) / F.size(terms)))

    def of(x: Column) -> Column:
        return T.let(claims(answer), lambda ts: F.when(F.size(ts) == 0, 1.0).otherwise(_round(F.size(F.filter(ts, lambda w: F.contains(x, w))) / F.size(ts))))

    return F.when((answer == "") | (F.size(sources) == 0), 0.0).otherwise(T.let(corpus(sources), of) if text is None else of(text))


def hallucination(answer: Column, sources: Column, text: Column | None = None, held: Column | None = None) -> Column:
    """1 less the share of penalties: numbers other than 0 to 10 weigh 1, words over five bytes 0.5, repeats count; 0.5 without sources. ``held``: the words and numbers that sources hold, if they are known."""
    low = F.lower(answer)

    def of(x: Column, numbers: Column, words: Column) -> Column:
        missing = lambda xs: F.size(F.filter(xs, lambda w: ~F.contains(x, w) if held is None else ~F.array_contains(held, w)))
        most = F.size(numbers) + 0.5 * F.size(words)
        return F.when(most == 0, 1.0).otherwise(_round(T.clamp(1 - (missing(numbers) + 0.5 * missing(words)) / most)))

    def within(x: Column) -> Column:
        numbers = F.filter(_numbers(low), lambda n: ~n.rlike("^([0-9]|10)$"))
        words = F.filter(T.evaluation_words(low), lambda w: F.octet_length(w) > 5)
        return T.let(numbers, lambda ns: T.let(words, lambda ws: of(x, ns, ws)))

    return F.when(answer == "", 0.0).when(F.size(sources) == 0, 0.5).otherwise(T.let(corpus(sources), within) if text is None else within(text))


def score(answers: DataFrame) -> DataFrame:
    """Adds every metric of an answer, and whether it passes (accuracy and context recall of at least a half)."""
    a, q, f, s = (F.col(c) for c in ("answer", "question", "facts", "sources"))
    settle(answers.sparkSession)
    texts = F.transform(s, lambda x: F.lower(F.concat(x["content"], F.lit(" "), x["heading"])))
    told = answers.withColumn("q_words", T.evaluation_words(q)).withColumn("q_terms", claims(a))
    # hundreds of words are looked for in long texts: Python does that sooner than a loop over a text's bytes
    told = told.withColumn("q_counts", _counts_in("q_words", texts)).withColumn("q_held", _words_in("q_terms", corpus(s)))
    words, terms, counts, held = (F.col(c) for c in ("q_words", "q_terms", "q_counts", "q_held"))

    def metrics(text: Column) -> Column:
        made = {
            "faithfulness": faithfulness(a, s),
            "relevance": relevance(q, s, words, counts),
            "accuracy": accuracy(a, f),
            "context_recall": context_recall(s, f, text),
            "citation_quality": citation_quality(a, s),
            "claim_grounding": claim_grounding(a, s, text, terms, held),
            "hallucination": hallucination(a, s, text, held),
            "confidence": heuristic_confidence(a, s),
        }
        return F.struct(*[c.alias(name) for name, c in made.items()])

    out = told.withColumn("q_metrics", T.let(corpus(s), metrics)).select(*answers.columns, "q_metrics.*")
    return out.withColumn("passed", (F.col("accuracy") >= 0.5) & (F.col("context_recall") >= 0.5))


def heuristic_confidence(answer: Column, sources: Column) -> Column:
    """0.5, up to 0.2 for references to sources, less 0.1 for each hedge."""
    low = F.lower(answer)
    refs = F.aggregate(sources, F.lit(0), lambda n, s: n + F.contains(low, F.lower(s["filename"])).cast("int") + _has(low, F.lower(s["heading"])).cast("int"))
    return F.when((answer == "") | (F.size(sources) == 0), 0.0).otherwise(_round(T.clamp(0.5 + 0.2 * F.least(refs, F.lit(3)) / 3 - 0.1 * T.count_of(low, T.HEDGES))))


def validate(answers: DataFrame, compatible: bool = True) -> DataFrame:
    """Adds citation_issues, consistency_issues, validation_confidence and validation_summary.

    ``compatible`` looks for fabricated references between full stops, where a file name with an extension can't stand; otherwise in sentences.
    """
    a, s = F.col("answer"), F.col("sources")
    low = F.lower(a)
    named = F.exists(s, lambda x: _has(low, F.lower(x["filename"])) | _has(low, F.lower(x["heading"])))
    pieces = F.transform(F.split(a, "\\.") if compatible else T.sentences(a), T.trimmed)
    cited = lambda p: F.exists(s, lambda x: _has(F.lower(p), F.lower(x["filename"])))
    fabricated = F.filter(pieces, lambda p: T.any_of(F.lower(p), ["according to", "as stated in"]) & ~cited(p) & T.any_of(F.lower(p), ["document", "report"]))
    none = F.when((F.size(s) > 0) & ~named, F.array(F.lit("No provided source is named"))).otherwise(F.array().cast("array<string>"))
    against = F.array_repeat(F.lit("Possible self-contradiction"), T.count_of(low, T.NEGATIONS))
    outside = F.when(T.any_of(low, T.EXTERNAL), F.array(F.lit("Knowledge from outside the sources"))).otherwise(F.array().cast("array<string>"))
    out = answers.withColumn("citation_issues", F.concat(none, F.transform(fabricated, lambda p: F.concat(F.lit("Reference may be made up: "), p)))).withColumn("consistency_issues", F.concat(against, outside))
    c, k = F.size("citation_issues"), F.size("consistency_issues")
    text = F.concat_ws("\n", F.when(c > 0, F.concat(F.lit("Citations: "), F.concat_ws("; ", "citation_issues"))), F.when(k > 0, F.concat(F.lit("Consistency: "), F.concat_ws("; ", "consistency_issues"))))
    return out.withColumn("validation_confidence", _round(F.greatest(F.lit(0.0), 1 - 0.15 * c - 0.2 * k))).withColumn("validation_summary", F.when(text == "", "No issues.").otherwise(text))


CITED = [r"\(([^)]+\.(?:docx|pdf|pptx|xlsx))[^)]*\)", r"(?:Sec\.|Section|§)\s*(\d+(?:\.\d+)*)", r"(?:Art\.|Article)\s*(\d+(?:\.\d+)*)", r"(?:Cl\.|Clause)\s*(\d+(?:\.\d+)*)", r"(?:p\.|Page)\s*(\d+)", r"\[Source\s*(\d+)\]"]


def citations(answer: Column, sources: Column) -> Column:
    """array<struct<text, ref, chunk_id, verified>>: every citation once, matched by file name, heading, page, then number of the source."""
    found = F.concat(*[F.zip_with(F.regexp_extract_all(answer, F.lit(f"({p})"), F.lit(1)), F.regexp_extract_all(answer, F.lit(p), F.lit(1)), lambda t, r: F.struct(T.trimmed(t).alias("text"), r.alias("ref"))) for p in CITED])
    once = F.filter(found, lambda c, i: F.array_position(F.transform(found, lambda x: x["text"]), c["text"]) == i + 1)

    def match(c: Column) -> Column:
        low = F.lower(c["ref"])
        number = F.regexp_extract(c["ref"], r"^(\d{1,9})", 1).try_cast("int")
        first = lambda f: F.try_element_at(F.filter(sources, f), F.lit(1))["chunk_id"]
        by_number = F.when((number > 0) & (number <= F.size(sources)), F.try_element_at(sources, number)["chunk_id"])
        return F.coalesce(first(lambda s: F.contains(F.lower(s["filename"]), low)), first(lambda s: (s["heading"] != "") & F.contains(F.lower(s["heading"]), low)), first(lambda s: (number > 0) & (s["page_number"] == number)), by_number)

    return F.transform(once, lambda c: F.struct(c["text"].alias("text"), c["ref"].alias("ref"), match(c).alias("chunk_id"), match(c).isNotNull().alias("verified")))


def composite_confidence(answer: Column, sources: Column) -> Column:
    """0.3 coverage of the first five sources, 0.3 verified citations, 0.25 consistency, 0.15 length."""
    low = F.lower(answer)
    five = F.slice(sources, 1, 5)

    def used(s: Column) -> Column:
        words = T.fields(s["content"])
        return _has(low, F.lower(s["filename"])) | _has(low, F.lower(s["heading"])) | ((F.size(words) > 5) & F.contains(low, F.lower(F.concat_ws(" ", F.slice(words, 1, 5)))))

    coverage = F.when(F.size(sources) == 0, 0.0).otherwise(F.size(F.filter(five, used)) / F.size(five))
    made = citations(answer, sources)
    verified = F.when(F.size(made) == 0, 0.5).otherwise(F.size(F.filter(made, lambda c: c["verified"])) / F.size(made))
    steady = F.greatest(F.lit(0.0), 1 - 0.15 * T.count_of(low, T.CONTRADICTIONS) - 0.2 * T.count_of(low, T.UNCERTAIN))
    n = T.n_words(answer)
    length = F.when(n < 10, 0.2).when(n < 30, 0.5).when(n < 100, 0.8).when(n < 500, 1.0).otherwise(0.9)
    return _round(T.clamp(0.3 * coverage + 0.3 * verified + 0.25 * steady + 0.15 * length))


def snippets(contents: Column, words: Column) -> Column:
    """Of every content the sentence that shares most words with the answer, and the better neighbour if both fit in 300 bytes; empty if none shares any."""
    settle(SparkSession.active())
    return _snippets(contents, words)


_END = re.compile(r"[.?!](?=[ \n\t]|\Z)")


def _sentences(text: str) -> list[str]:
    """As ``text.sentences`` has them."""
    ends = [m.end() for m in _END.finditer(text)]
    pieces = (text[a:b].strip(" \t\n\r\f") for a, b in zip([0, *ends], [*ends, len(text)], strict=True))
    return [p for p in pieces if p]


def best_snippet(content: str, words: set[str]) -> str:
    s = _sentences(content)
    scores = [len(words & set(scoring.cut_words(x.lower()))) for x in s]
    top = max(scores, default=0)
    if not top:
        return ""
    i = scores.index(top)
    own, both = s[i], None
    after, before = scores[i + 1] if i + 1 < len(s) else 0, scores[i - 1] if i else 0
    if after >= before and after > 0:
        both = f"{own} {s[i + 1]}"
    elif before > 0:
        both = f"{s[i - 1]} {own}"
    return both if both is not None and len(own.encode()) < 300 and len(both.encode()) <= 300 else own


@F.arrow_udf(Ty.ArrayType(Ty.StringType()))
def _snippets(contents: pa.Array, words: pa.Array) -> pa.Array:
    made = []
    for cs, w in zip(contents, words, strict=True):
        own = set(w.as_py() or ())
        made.append(None if cs.as_py() is None else [best_snippet(c or "", own) for c in cs.as_py()])
    return pa.array(made, pa.list_(pa.string()))


def found(answer: Column) -> Column:
    """False when an answer says that the documents don't have it."""
    return ~T.any_of(F.lower(answer), T.NOT_FOUND)


def span_match(content: Column, filename: Column, span: Column, path: Column) -> Column:
    """A chunk holds a span, or is of the same file and holds over half of its words (only words over three bytes can count)."""
    low, want = F.lower(content), F.lower(span)
    words = T.fields(want)
    share = F.size(F.filter(words, lambda w: (F.octet_length(w) > 3) & F.contains(low, w))) / F.greatest(F.size(words), F.lit(1))
    return F.contains(low, want) | ((F.lower(filename) == F.lower(path)) & (share > 0.5))


def at_k(retrieved: DataFrame, truth: DataFrame, ks: list[int] = KS) -> DataFrame:
    """(query_id, k, precision, recall) for every query with truth.

    ``retrieved``: query_id, rank, content, filename.  ``truth``: query_id, span_id, span, path.  Each chunk meets only the spans of its own query.
    """
    pairs = retrieved.join(truth, "query_id").withColumn("hit", span_match(F.col("content"), F.col("filename"), F.col("span"), F.col("path")))
    grid = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    relevant = pairs.groupBy("query_id", "rank").agg(F.bool_or("hit").alias("hit")).select("*", grid).where("rank <= k")
    precision = relevant.groupBy("query_id", "k").agg((F.sum(F.col("hit").cast("int")) / F.count(F.lit(1))).alias("precision"))
    first = pairs.where("hit").groupBy("query_id", "span_id").agg(F.min("rank").alias("first"))
    spans = truth.select("query_id", "span_id").join(first, ["query_id", "span_id"], "left").select("*", grid)
    recall = spans.groupBy("query_id", "k").agg(F.avg(F.coalesce((F.col("first") <= F.col("k")).cast("double"), F.lit(0.0))).alias("recall"))
    out = recall.join(precision, ["query_id", "k"], "left")
    return out.select("query_id", "k", _round(F.coalesce("precision", F.lit(0.0))).alias("precision"), _round(F.col("recall")).alias("recall"))


STAGES = ["PASS", "MODEL_MISS", "RETRIEVAL_MISS", "EMBEDDING_MISS", "CHUNK_MISS"]


#: Texts, and characters of all of them, that workers hold to look for them; of those without a word inside, which are looked for one by one.
HELD, LOOSE = (1 << 16, 1 << 24), 256


def _held(chunks: DataFrame, keyed: dict[str, list[str]], loose: list[str]) -> DataFrame:
    """(low, chunk_id): one pass over the chunks. ``keyed``: texts by a word that a chunk must have; ``loose``: texts without one."""
    settle(chunks.sparkSession)

    def run(batches):
        for batch in batches:
            lows, at = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text is None:
                    continue
                got = [low for w in keyed.keys() & set(scoring.cut_words(text)) for low in keyed[w] if low in text] + [low for low in loose if low in text]
                lows.extend(got)
                at.extend([i] * len(got))
            yield pa.RecordBatch.from_arrays([pa.array(lows, pa.string()), batch.column(0).take(pa.array(at, pa.int64()))], names=["low", "chunk_id"])

    schema = Ty.StructType([Ty.StructField("low", Ty.StringType()), chunks.schema["chunk_id"]])
    return chunks.select("chunk_id", F.lower("content").alias("content")).mapInArrow(lean(run), schema).distinct()


def holding(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(low, chunk_id) of every chunk whose lower-case content holds a text. ``wanted``: low, each once.

    Containment has no equi-join key, so every text gets a key that its chunks must have: of the whole words inside it the one in fewest chunks; without such a word,
    each word of the corpus that contains its longest piece, found by the piece's first three characters; without letters and digits, its first character.  Chunks
    found by key are then tested.  As long as the texts fit ``HELD``, all this is done in one pass over the chunks by workers that hold them, the key being the longest word inside.
    """
    few, most = HELD
    rows = wanted.select("low").limit(few + 1).collect()
    lows = [r["low"] for r in rows if r["low"] is not None]
    keyed: dict[str, list[str]] = {}
    loose = []
    for low in lows:
        words = scoring.cut_words(low)
        inner = words[bool(words) and low.startswith(words[0]) : len(words) - (bool(words) and low.endswith(words[-1]))]
        if inner:
            keyed.setdefault(max(inner, key=len), []).append(low)
        else:
            loose.append(low)
    if len(rows) <= few and sum(map(len, lows)) <= most and len(loose) <= LOOSE:
        return _held(chunks, keyed, loose)
    pieces = wanted.withColumn("pieces", F.split("low", SEPARATORS)).select("low", "pieces", F.filter(F.expr("slice(pieces, 2, greatest(size(pieces) - 2, 0))"), lambda w: w != "").alias("inner"))
    inner = pieces.select("low", F.explode(F.array_distinct("inner")).alias("term"))
    low_chunks = chunks.select("chunk_id", F.lower("content").alias("content"))
    posts = asked_postings(low_chunks, inner)
    df = posts.groupBy("term").agg(F.count(F.when(F.col("chunk_id").isNotNull() & (F.col("tf") > 0) & (F.col("dl") > 0), 1)).alias("df"))
    rarest = inner.join(df, "term", "left").groupBy("low").agg(F.min_by("term", F.coalesce("df", F.lit(0))).alias("term"))
    by_word = posts.join(rarest, "term").select("low", "chunk_id")
    # texts without a whole word inside
    edges = pieces.where("size(inner) = 0").select("low", F.array_max(F.transform(F.filter("pieces", lambda w: w != ""), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"].alias("piece"))
    words = low_chunks.select("chunk_id", F.explode_outer(F.array_distinct(terms(F.col("content")))).alias("word"))
    starts = lambda w: F.flatten(F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.array(*[F.substring(w, i, F.lit(n)) for n in (1, 2, 3)])))
    grams = words.select("word").where("word is not null").distinct().select("word", F.explode(F.array_distinct(starts(F.col("word")))).alias("gram"))
    around = edges.where("piece is not null").withColumn("gram", F.left("piece", F.lit(3))).join(grams, "gram").where(F.contains("word", F.col("piece"))).select("low", "word")
    by_piece = words.join(around, "word").select("low", "chunk_id")
    marks = low_chunks.select("chunk_id", F.explode(F.array_distinct(F.split(F.regexp_replace("content", r"[\p{L}\p{Nd}]+", ""), ""))).alias("mark"))
    by_mark = marks.join(edges.where("piece is null").withColumn("mark", F.left("low", F.lit(1))), "mark").select("low", "chunk_id")
    found = by_word.unionByName(by_piece).unionByName(by_mark).distinct()
    return found.join(low_chunks, "chunk_id").where(F.contains("content", F.col("low"))).select("low", "chunk_id")


def diagnose(facts: DataFrame, chunks: DataFrame, embedded: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(query_id, fact, chunk_id, stage): where a fact got lost. Only the first chunk that holds the fact is followed.

    ``facts``: query_id, fact, answer.  ``chunks``: chunk_id, content.  ``embedded``: chunk_id.  ``retrieved``: query_id, chunk_id.
    """
    holds = holding(chunks, facts.select(F.lower("fact").alias("low")).distinct()).groupBy("low").agg(F.min("chunk_id").alias("chunk_id"))
    rows = facts.withColumn("low", F.lower("fact")).join(holds, "low", "left")
    rows = rows.join(embedded.select("chunk_id").distinct().withColumn("is_embedded", F.lit(True)), "chunk_id", "left")
    rows = rows.join(retrieved.select("query_id", "chunk_id").distinct().withColumn("is_found", F.lit(True)), ["query_id", "chunk_id"], "left")
    stage = F.when(F.col("chunk_id").isNull(), "CHUNK_MISS").when(F.col("is_embedded").isNull(), "EMBEDDING_MISS").when(F.col("is_found").isNull(), "RETRIEVAL_MISS").when(~F.contains(F.lower("answer"), F.col("low")), "MODEL_MISS").otherwise("PASS")
    return rows.select("query_id", "fact", "chunk_id", stage.alias("stage"))


def worst_stage(diagnosed: DataFrame) -> DataFrame:
    """(query_id, stage): the worst over a query's facts."""
    severity = F.array_position(T.literals(STAGES), F.col("stage"))
    return diagnosed.groupBy("query_id").agg(F.max_by("stage", severity).alias("stage"))


def report(scored: DataFrame, metrics: list[str], category: str = "category", failed: str | None = None) -> DataFrame:
    """(category, tests, passed, mean of every metric): overall (category null) and by category, one pass; tests with errors don't enter the means."""
    ok = F.lit(True) if failed is None else F.col(failed).isNull()
    return scored.groupingSets([[], [category]], category).agg(F.count(F.lit(1)).alias("tests"), F.sum(F.coalesce(F.col("passed"), F.lit(False)).cast("int")).cast("bigint").alias("passed"), *[_round(F.avg(F.when(ok, F.col(m)))).alias(m) for m in metrics])
