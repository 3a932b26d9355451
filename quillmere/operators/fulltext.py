"""Full-text search as an index engine does it: folded accents, Porter stems, phrases, BM25 over terms and phrases."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quillmere.functions import text as T
from quillmere.operators import scoring
from quillmere.operators.retrieval import B, K1, ranked

_STEP2 = [("ational", "ate"), ("ization", "ize"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("tional", "tion"), ("biliti", "ble"), ("entli", "ent"), ("ousli", "ous"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("iviti", "ive"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("ator", "ate"), ("eli", "e")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = sorted("al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split(), key=len, reverse=True)


def _shape(word: str) -> str:
    """v for vowels, c for consonants; y is a vowel behind a consonant."""
    out = []
    for i, ch in enumerate(word):
        out.append("v" if ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c") else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _cvc(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


@lru_cache(1 << 18)
def stem(word: str) -> str:
    """Porter's algorithm (1980) on a lower-case word; words of other than ASCII letters stay as they are."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end, new in table:
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + new
                break
    for end in _STEP4:
        if w.endswith(end):
            if _measure(w[: -len(end)]) > 1:
                w = w[: -len(end)]
            break
    else:
        if w.endswith(("sion", "tion")) and _measure(w[:-3]) > 1:
            w = w[:-3]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@lru_cache(1 << 18)
def _fold(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


@F.arrow_udf(ArrayType(StringType()))
def _stems(text: pa.Array) -> pa.Array:
    cut = re.compile(r"[^\W_]+")
    return pa.array([[stem(_fold(w)) for w in cut.findall((t or "").lower())] for t in text.to_pylist()], pa.list_(pa.string()))


def stems(text: Column) -> Column:
    """Folded, stemmed terms of a text in order; a null text has none."""
    return _stems(text)


def index(chunks: DataFrame, key: str = "chunk_id", text: str = "content", heading: str | None = None) -> DataFrame:
    """(key, dl, ts): stems of every chunk in order, and their number; of heading and text, if a heading column is named. What a store keeps, so that texts are stemmed once."""
    whole = F.col(text) if heading is None else F.concat_ws(" ", F.col(heading), F.col(text))
    return chunks.select(key, stems(whole).alias("ts")).withColumn("dl", F.size("ts").cast("bigint"))


def _features(number: dict[str, int], phrased: dict[str, list[str]], grouped: dict[str, list[str]], asked: set[int], cut_up: bool):
    """For a text, or with ``cut_up`` false for its stems: their number, and how often each asked term, phrase and group is there.

    ``phrased``: terms that a phrase has; ``grouped``: parts of a group.  Either is looked for where the rarest-looking of its terms is, the longest.
    """
    keyed: dict[int, list] = {}
    for feature, terms in [*phrased.items(), *grouped.items()]:
        pattern = re.compile(re.escape(feature.rstrip(" ")) + "(?= )") if feature in phrased else None
        keyed.setdefault(number[max(terms, key=len)], []).append((frozenset(number[t] for t in terms), number[feature], pattern))
    cut = re.compile(r"[^\W_]+")
    known: dict[str, int | None] = {}

    def find(value):
        words = cut.findall(value.lower()) if cut_up else value
        got: dict[int, int] = {}
        for w, times in Counter(words).items():
            if w in known:
                t = known[w]
            else:
                if len(known) > 1 << 18:
                    known.clear()
                t = known[w] = number.get(stem(_fold(w)) if cut_up else w)
            if t is not None:
                got[t] = got.get(t, 0) + times
        line = None
        for t in [t for t in got if t in keyed]:
            for terms, feature, pattern in keyed[t]:
                if not terms <= got.keys():
                    continue
                if pattern is None:
                    times = min(got[x] for x in terms)
                else:
                    line = line or " " + " ".join(stem(_fold(w)) if cut_up else w for w in words) + " "
                    times = len(pattern.findall(line))
                if times:
                    got[feature] = times
        return len(words), {t: n for t, n in got.items() if t in asked}

    return find


def search(chunks: DataFrame | None, queries: DataFrame, top: int | None = None, key: str = "chunk_id", text: str = "content", indexed: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """(query_id, key, score, matched, rank): BM25 over stemmed terms; the whole question as a phrase counts as one more term where it occurs.

    As long as the questions have at most ``scoring.BOUND`` terms, texts are read and stemmed once, by workers that know them.  Beyond that, by joins: a phrase can only stand in a chunk that holds its terms: matched chunks are tested for it as strings of stems, and no positions are shuffled.  ``indexed`` is an
    index made before; ``groups`` (query_id, term) are more terms of a question, such as translations: one of several words counts where all of them are, once.
    """
    low = F.lower(T.without_specials(F.col("question")))
    kept = F.filter(T.fields(low), lambda w: (F.octet_length(w) > 2) & ~F.array_contains(T.literals(T.RETRIEVAL_STOPS), w))
    asked = queries.select("query_id", stems(F.concat_ws(" ", kept)).alias("kept"), stems(low).alias("words")).select("query_id", F.array_distinct("kept").alias("kept"), F.concat(F.lit(" "), F.concat_ws(" ", "words"), F.lit(" ")).alias("phrase"), F.size("words").alias("n_words"))
    terms = asked.select("query_id", F.explode("kept").alias("term"))
    wanted = terms.select("term")
    held = asked.limit(scoring.BOUND + 1).collect()
    more = [] if groups is None else groups.select("query_id", stems(F.col("term")).alias("parts")).limit(scoring.BOUND + 1).collect()
    if sum(1 + len(r["kept"]) for r in held) + sum(1 + len(r["parts"]) for r in more) <= scoring.BOUND:
        number: dict[str, int] = {}
        of = lambda feature: number.setdefault(feature, len(number))
        pairs = {(r["query_id"], of(t)) for r in held for t in r["kept"]}
        phrased = {r["phrase"]: r["kept"] for r in held if r["n_words"] > 1 and r["kept"]}
        pairs |= {(r["query_id"], of(r["phrase"])) for r in held if r["phrase"] in phrased and r["kept"]}
        grouped_of = {" " + " ".join(p): p for r in more if (p := list(dict.fromkeys(r["parts"])))}
        pairs |= {(r["query_id"], of(" " + " ".join(p))) for r in more if (p := list(dict.fromkeys(r["parts"])))}
        for p in grouped_of.values():
            for t in p:
                of(t)
        value, cut_up = (F.coalesce(text, F.lit("")).alias("q_value"), True) if indexed is None else (F.col("ts").alias("q_value"), False)
        packed = scoring.pack((chunks if indexed is None else indexed).select(key, value), key, "q_value", _features(number, phrased, grouped_of, {t for _, t in pairs}, cut_up))
        return ranked(scoring.best(packed, sorted(pairs, key=repr), queries.schema["query_id"].dataType, key, top, df_by_length=False), "score", key, top)
    grouped = None
    if groups is not None:
        parts = groups.select("query_id", F.array_distinct(stems(F.col("term"))).alias("parts")).where("size(parts) > 0").select("query_id", "parts", F.concat(F.lit(" "), F.concat_ws(" ", "parts")).alias("group")).distinct()
        grouped = parts.select("query_id", "group", F.size("parts").alias("n_parts"), F.explode("parts").alias("term"))
        wanted = wanted.union(grouped.select("term"))
    indexed = index(chunks, key, text) if indexed is None else indexed.select(key, "ts", "dl")
    stats = indexed.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    posts = indexed.select(key, "dl", F.explode_outer("ts").alias("term")).join(wanted.distinct(), "term", "left_semi").repartition(F.col(key)).groupBy("term", key, "dl").agg(F.count(F.lit(1)).alias("tf"))
    matched = posts.join(terms, "term").select("query_id", key, "dl", F.col("term"), "tf")
    # phrases: among chunks that hold every kept term of the question
    whole = matched.groupBy("query_id", key, "dl").agg(F.count(F.lit(1)).alias("m")).join(asked.where("n_words > 1"), "query_id").where("m = size(kept)")
    text_of = indexed.select(key, F.concat(F.lit(" "), F.concat_ws(" ", "ts"), F.lit(" ")).alias("line"))
    times = F.size(F.split("line", F.concat(F.lit("\\Q"), F.rtrim("phrase"), F.lit("\\E(?= )")), -1)) - 1
    phrases = whole.join(text_of, key).withColumn("tf", times.cast("bigint")).where("tf > 0").select("query_id", key, "dl", F.col("phrase").alias("term"), "tf")
    every = matched.unionByName(phrases)
    if grouped is not None:
        all_of = posts.join(grouped, "term").groupBy("query_id", "group", "n_parts", key, "dl").agg(F.count(F.lit(1)).alias("m"), F.min("tf").alias("tf")).where("m = n_parts")
        every = every.unionByName(all_of.select("query_id", key, "dl", F.col("group").alias("term"), "tf"))
    df = every.select("term", key).distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = every.join(df, "term").crossJoin(F.broadcast(stats))  # stats is one row
    total = scored.groupBy("query_id", key).agg(F.round(F.sum(part), 6).alias("score"), F.count(F.lit(1)).alias("matched"))
    return ranked(total, "score", key, top)
