"""Scores of all questions at once by BM25 over features of texts: words, phrases, groups of words.

Texts are read once, in Python workers: of a text only its length and the features that some question asks for are kept, as one packed row a chunk in the
shared checkpoint folder.  How many chunks have a feature is counted over that table; then each task adds up the scores of its chunks in numpy and keeps
the best ``top`` a question.  What goes to the workers are the questions' features, ``BOUND`` pairs at most; callers count them first.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from quillmere.functions.batches import lean, settle
from quillmere.operators.lineage import cut

#: Pairs of question and feature that are held by every worker.
BOUND = 1 << 18
K1, B = 1.2, 0.75
#: Packed features of a chunk.
PACKED = "array<struct<term int, tf int, dl int>>"


_ALNUM = re.compile(r"[^\W_]+")


@lru_cache(1)
def _other_numbers() -> re.Pattern:
    return re.compile("[" + "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("No", "Nl")) + "]+")


def cut_words(text: str) -> list[str]:
    """Runs of letters and decimal digits. Python's own class has other numbers too, such as fractions; words that have any are cut at them."""
    found = _ALNUM.findall(text)
    if text.isascii() or all(w.isascii() or w.isalpha() for w in found):
        return found
    return [x for w in found for x in ([w] if w.isascii() else _other_numbers().split(w)) if x]


def words(wanted: dict[str, int]):
    """For a lower-case text: its number of words, and how often each wanted one is there."""

    def find(text: str) -> tuple[int, dict[int, int]]:
        found = cut_words(text)
        return len(found), Counter(wanted[w] for w in found if w in wanted)

    return find


def pack(rows: DataFrame, key: str, value: str, find) -> DataFrame:
    """(key, n, n_dl, sum_dl, ts): a row a chunk, written once. ``find`` gives the length of a value and {feature: times}; a null has neither."""
    spark = rows.sparkSession
    settle(spark)

    def run(batches):
        for batch in batches:
            n, at, term, tf, dl, lens = batch.num_rows, [0], [], [], [], []
            for v in batch.column(1).to_pylist():
                size, got = (None, {}) if v is None else find(v)
                lens.append(size)
                term.extend(got.keys())
                tf.extend(got.values())
                dl.extend([size] * len(got))
                at.append(len(term))
            packed = pa.StructArray.from_arrays([pa.array(a, pa.int32()) for a in (term, tf, dl)], ["term", "tf", "dl"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lens, pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), packed)], names=[key, "dl", "ts"])

    schema = Ty.StructType([rows.schema[key], Ty.StructField("dl", Ty.LongType()), Ty.StructField("ts", Ty.DataType.fromDDL(PACKED))])
    made = rows.select(key, value).mapInArrow(lean(run), schema)
    # rows of one key are one chunk
    grouped = made.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count("dl").alias("n_dl"), F.coalesce(F.sum("dl"), F.lit(0)).alias("sum_dl"), F.flatten(F.collect_list("ts")).alias("ts"))
    return cut(grouped, "packed")


def best(packed: DataFrame, asked: list[tuple], query_type: Ty.DataType, key: str, top: int | None = None, df_by_length: bool = True) -> DataFrame:
    """(query_id, key, score, matched), not ranked yet: all hits, or with ``top`` those that may be among a question's best.

    ``asked``: pairs of question and feature.  ``df_by_length``: rows of one key, but of different lengths, count as several chunks that have a feature.
    """
    spark = packed.sparkSession
    stats = packed.agg(F.sum("n").alias("n"), F.sum("n_dl").alias("n_dl"), F.sum("sum_dl").alias("dl")).first()
    posts = packed.select(key, "n", F.explode_outer("ts").alias("t")).select(key, "n", "t.term", "t.tf", "t.dl")
    one = F.when(F.col("n") == 1, F.col("term"))  # of rows that share a key, a feature of one length counts once
    once = posts.where("n = 1").groupBy(one.alias("term")).agg(F.count(F.lit(1)).alias("df"))
    more = posts.where("n > 1").select(key, "term", *(["dl"] if df_by_length else [])).distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    counted = once.unionByName(more).where("term is not null").groupBy("term").agg(F.sum("df").alias("df")).collect()
    ids = list(dict.fromkeys(q for q, _ in asked))
    place = {q: i for i, q in enumerate(ids)}
    size = 1 + max((t for _, t in asked), default=0)
    df = np.zeros(size)
    for r in counted:
        df[r["term"]] = r["df"]
    n, mean = float(stats["n"] or 0), (stats["dl"] or 0) / (stats["n_dl"] or 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        idf = np.maximum(np.nan_to_num(np.log(np.maximum((n - df + 0.5) / (df + 0.5), 1e-300))), 1e-6)
    pairs = sorted((t, place[q]) for q, t in asked)
    flat = np.array([q for _, q in pairs], np.int64)
    ptr = np.searchsorted(np.array([t for t, _ in pairs], np.int64), np.arange(size + 1))
    fields = [Ty.StructField("query_id", query_type), packed.schema[key], Ty.StructField("score", Ty.DoubleType()), Ty.StructField("matched", Ty.LongType())]
    n_q = max(1, len(ids))

    def scores(keys: pa.Array, rows: np.ndarray, term: np.ndarray, tf: np.ndarray, dl: np.ndarray):
        """(row of keys, question, score, matched) of every hit; ``rows`` says to which key a posting belongs."""
        part = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))
        times = ptr[term + 1] - ptr[term]
        of = np.repeat(np.arange(len(term)), times)
        q = flat[np.repeat(ptr[term], times) + np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)]
        cell = rows[of] * n_q + q
        if len(keys) * n_q <= 1 << 22:
            total, hits = np.bincount(cell, part[of], len(keys) * n_q), np.bincount(cell, minlength=len(keys) * n_q)
            at = np.flatnonzero(hits)
            total, hits = total[at], hits[at]
        else:
            at, inverse = np.unique(cell, return_inverse=True)
            total, hits = np.bincount(inverse, part[of], len(at)), np.bincount(inverse, minlength=len(at))
        return at // n_q, at % n_q, np.round(total, 6), hits

    def run(batches):
        names = pa.array(ids, type=None if ids else pa.int64())
        floor = np.full(n_q, -np.inf)
        kept: list[tuple] = []  # (keys, question, score, matched)

        def rows_of(table: pa.Table):
            runs = pc.run_end_encode(table.column(0).combine_chunks(), run_end_type=pa.int32())
            ends = runs.run_ends.to_numpy()
            keys, rows = runs.values, np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            many, term, tf, dl = (table.column(i).to_numpy() for i in range(1, 5))
            if (many > 1).any():
                order = np.lexsort((dl, term, rows))
                r, t, d = rows[order], term[order], dl[order]
                first = np.flatnonzero(np.r_[True, (np.diff(r) != 0) | (np.diff(t) != 0) | (np.diff(d) != 0)]) if len(r) else np.zeros(0, int)
                rows, term, dl, tf = r[first], t[first], d[first], np.add.reduceat(tf[order], first) if len(first) else tf[:0]
            return keys, *scores(keys, rows, term.astype(np.int64), tf.astype(float), dl.astype(float))

        def merged():
            keys = pa.concat_arrays([k for k, *_ in kept])
            return keys, *(np.concatenate([x[i] for x in kept]) for i in (1, 2, 3))

        def cut_down() -> None:
            keys, q, x, m = merged()
            plain = pa.types.is_integer(keys.type) and not keys.null_count
            order = np.lexsort((keys.to_numpy(), -x, q)) if plain else np.lexsort((-x, q))
            q, x = q[order], x[order]
            start = np.searchsorted(q, q, side="left")
            nth = np.arange(len(q)) - start
            last = np.flatnonzero(nth == top - 1)
            floor[q[last]] = x[last]
            stay = nth < top if plain else x >= floor[q]  # ties are told apart by the final rank
            kept[:] = [(keys.take(pa.array(order[stay])), q[stay], x[stay], m[order[stay]])]

        def out(keys, q, x, m):
            for s in range(0, max(1, len(q)), 1 << 16):
                e = s + (1 << 16)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(q[s:e])), keys.slice(s, len(q[s:e])), pa.array(x[s:e]), pa.array(m[s:e], pa.int64())], names=["query_id", key, "score", "matched"])

        def add(table: pa.Table):
            if not len(table):
                return
            keys, at, q, x, m = rows_of(table)
            if top is not None:
                good = x >= floor[q]
                at, q, x, m = at[good], q[good], x[good], m[good]
            if len(q):
                kept.append((keys.take(pa.array(at)), q, x, m))

        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            runs = pc.run_end_encode(table.column(0).combine_chunks(), run_end_type=pa.int32()).run_ends
            whole = runs[len(runs) - 2].as_py() if len(runs) > 1 else 0  # the last key may go on in the next batch
            add(table.slice(0, whole).filter(pc.is_valid(table.column(2).slice(0, whole))))
            rest = table.slice(whole)
            if top is None and kept:
                yield from out(*merged())
                kept.clear()
            elif sum(len(x[1]) for x in kept) > max(1 << 18, 4 * n_q * (top or 1)):
                cut_down()
        if rest is not None:
            add(rest.filter(pc.is_valid(rest.column(2))))
        if kept:
            if top is not None:
                cut_down()
            yield from out(*merged())

    return posts.mapInArrow(lean(run), Ty.StructType(fields))
