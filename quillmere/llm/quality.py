"""Quality classifier: Bradley-Terry scores from preference pairs, and a threshold at a score quantile.

Every labelled good document is preferred to every labelled bad one.  The chance that document *i* beats *j* is
``sigmoid(w . (x_i - x_j))``; ``w`` is fitted by minimising the logistic loss on the feature differences of a sample of such
pairs.  The fit runs on a bounded sample of labelled rows (``fit_rows``); the score, the threshold and the decision
cover every document.

Features are shares of byte classes, word statistics and repetition, computed by numpy over whole Arrow buffers.

Defined results: a null text counts as an empty one; labels that are null, or belong to no document, are left out; a null id
is scored like any other row; without both a good and a bad label every score is 0 and everything is kept; a score
equal to the threshold is kept.  Repeated rows get equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm import common as C

#: Symbols that get a feature each.
SYMBOLS = b"#$%&*|!?.,;:'\"(){}[]<>/\\=+-_@~^`"
NAMES = ["lower", "upper", "digit", "space", "newline", "control", "high", *[f"sym{c}" for c in SYMBOLS], "log_bytes", "log_words", "word_len", "distinct", "top_word", "repeat_next", "line_len", "short_lines", "symbol_words"]
DIM = len(NAMES)


def _classes() -> np.ndarray:
    table = np.zeros((256, 7 + len(SYMBOLS)))
    table[97:123, 0] = table[65:91, 1] = table[48:58, 2] = table[32, 3] = table[10, 4] = 1
    table[:32, 5] = 1
    table[10, 5] = 0
    table[128:, 6] = 1
    for i, c in enumerate(SYMBOLS):
        table[c, 7 + i] = 1
    return table


CLASSES = _classes()


def features(column: pa.Array) -> np.ndarray:
    """(rows, DIM) float features of a string column."""
    out = np.zeros((len(column), DIM))
    base = CLASSES.shape[1]
    for a, b, raw, off in C.chunks(column):
        n = b - a
        sizes = np.diff(off)
        row_of = np.repeat(np.arange(n), sizes)
        hist = np.bincount(row_of * 256 + raw, minlength=n * 256).reshape(n, 256)
        length = np.maximum(sizes, 1)
        f = out[a:b]
        f[:, :base] = hist @ CLASSES / length[:, None]
        f[:, base] = np.log1p(sizes)
        low = C.lowered(raw) if len(raw) else raw
        rows, starts, ends = C.words(low, off)
        count = np.bincount(rows, minlength=n)
        some = np.maximum(count, 1)
        f[:, base + 1] = np.log1p(count)
        f[:, base + 2] = np.bincount(rows, weights=ends - starts, minlength=n) / some / 10
        if len(rows):
            h = C.span_hashes(low, starts, ends)
            key = (rows.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24))
            key.sort()
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            first = np.flatnonzero(new)
            runs = np.diff(np.append(first, len(key)))
            owner = (key[first] >> np.uint64(40)).astype(np.int64)
            f[:, base + 3] = np.bincount(owner, minlength=n) / some
            top = np.zeros(n)
            np.maximum.at(top, owner, runs)
            f[:, base + 4] = top / some
            again = np.zeros(len(rows), bool)
            again[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
            f[:, base + 5] = np.bincount(rows, weights=again, minlength=n) / some
            after = np.where(ends < len(raw), raw[np.minimum(ends, len(raw) - 1)], 32)
            # what follows a row's last word is another document
            odd = (after != 32) & (after != 10) & (after != 46) & (after != 44) & (ends < off[rows + 1])
            f[:, base + 8] = np.bincount(rows, weights=odd, minlength=n) / some
        lines = hist[:, 10] + 1
        f[:, base + 6] = np.log1p(sizes / lines) / 10
        f[:, base + 7] = np.log1p(lines) / 10
    return out


@dataclass(frozen=True)
class Model:
    """A linear score: ``((x - mean) / scale) . weights``."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.round(np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights, 6)


def fit(good: np.ndarray, bad: np.ndarray, pairs: int = 100_000, ridge: float = 1e-3, steps: int = 60, seed: int = 7) -> Model | None:
    """Weights of least logistic loss on ``pairs`` differences good - bad, by Newton's method; None without pairs."""
    if not len(good) or not len(bad):
        return None
    both = np.concatenate([good, bad])
    mean, scale = both.mean(0), both.std(0)
    scale[scale < 1e-9] = 1
    scale = np.maximum(scale, 1e-4)
    rng = np.random.default_rng(seed)
    clip = lambda x: np.clip((x - mean) / scale, -8, 8)
    d = clip(good)[rng.integers(0, len(good), pairs)] - clip(bad)[rng.integers(0, len(bad), pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        gradient = -(d.T @ p) / pairs + ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return Model(mean, scale, w)


def _udf(model: Model | None):
    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        if model is None:
            return pa.array(np.zeros(len(text)))
        got = pa.array(model.score(features(text)))
        C.trim()
        return got

    return score


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", fit_rows: int = 12_000, pairs: int = 100_000) -> Model | None:
    """Fit on at most ``fit_rows`` labelled documents, those of least hashed id."""
    C.settle(docs.sparkSession)
    known = C.pick(labels, k=id_column, y=label_column).where("k is not null and y is not null")
    sample = known.withColumn("h", F.xxhash64("k")).orderBy("h", "k", "y").limit(fit_rows).drop("h")
    # the sample is bounded by fit_rows, whatever the input
    texts = C.pick(docs, k=id_column, t=text_column).join(F.broadcast(sample), "k").select("y", "t")

    def rows(batches):
        for batch in batches:
            x = features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), DIM).cast(pa.list_(pa.float64()))], names=["y", "x"])

    got = texts.mapInArrow(C.lean(rows), "y int, x array<double>").toPandas()
    if not len(got):
        return None
    x, y = np.stack(got["x"].to_numpy()), got["y"].to_numpy()
    order = np.lexsort((*x.T[:8], y))  # the fit doesn't depend on the order in which tasks end
    x, y = x[order], y[order]
    return fit(x[y > 0], x[y <= 0], pairs)


def threshold(scored: DataFrame, labels: DataFrame, id_column: str, label_column: str, quantile: float) -> float:
    """The ``quantile`` of the scores of all documents that are labelled good. ``scored``: columns k, score."""
    good = C.pick(labels, k=id_column, y=label_column).where("y > 0 and k is not null").select("k").distinct()
    # ids in ``good`` are distinct; a semi-join would be put below the scoring, and shuffle texts in place of scores
    found = scored.join(good, "k").agg(F.percentile_approx("score", F.lit(quantile), F.lit(100_000)).alias("t")).first()["t"]
    return float("-inf") if found is None else float(found)


def score_documents(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", quantile: float = 0.002, fit_rows: int = 12_000, pairs: int = 100_000) -> DataFrame:
    """(id, score, threshold, keep) of every document."""
    model = train(docs, labels, id_column, text_column, label_column, fit_rows, pairs)
    # scores are computed once and written: an id and a number a row
    scored = C.cut(C.pick(docs, k=id_column, t=text_column).select("k", _udf(model)("t").alias("score")), "scores")
    limit = threshold(scored, labels, id_column, label_column, quantile) if model is not None else float("-inf")
    return scored.select(F.col("k").alias(id_column), "score", F.lit(limit).alias("threshold"), (F.col("score") >= F.lit(limit)).alias("keep"))


def keep_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", quantile: float = 0.002, fit_rows: int = 12_000, pairs: int = 100_000) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns."""
    model = train(docs, labels, id_column, text_column, label_column, fit_rows, pairs)
    if model is None:
        return docs
    # scored where they lie, for the threshold and again for the filter: ids and scores are shuffled, texts never
    score = _udf(model)
    limit = threshold(C.pick(docs, k=id_column, t=text_column).select("k", score("t").alias("score")), labels, id_column, label_column, quantile)
    rows = C.wrapped(docs, t=text_column)
    return C.unwrapped(rows.where(score("t") >= F.lit(limit)), docs)
