"""Quality by positive-unlabelled learning.

Trusted positives (label 1) and unlabelled texts train a logistic model by the non-negative
unbiased risk  pi * Rp(+) + max(0, Ru(-) - pi * Rp(-)).  The class prior pi is estimated first: where
only good texts lie, unlabelled texts are as dense as pi times the positives, so pi is the least
ratio of the two over the regions that a positive-or-unlabelled model ranks highest. Rows labelled 0
teach nothing but stay among the unlabelled. A negative is then whatever the unlabelled texts hold
beyond pi times the positives, of whatever kind.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import null_safe
from .features import NAMES, standardise, text_stats

#: Bound on the rows that the model is fitted on: about so many positives, and as many unlabelled rows, drawn by a hash of doc_id; never more than 1.2 times as many.
SAMPLE = 20_000
#: Steps of gradient descent (Adam, full batch) and weight of the penalty on squared weights.
STEPS, PENALTY = 400, 1e-3
#: Score from which a text is taken as good.
CUT = 0.3
#: Shares of positives in the regions over which the prior is the least ratio.
REGIONS = np.linspace(0.3, 0.9, 25)


def _features(batches):
    for b in batches:
        parts = [x for _, x, *_ in text_stats(b.column(0))]
        flat = np.concatenate(parts).ravel() if parts else np.zeros(0, np.float32)
        at = pa.array(np.arange(b.num_rows + 1) * len(NAMES), pa.int32())
        yield pa.RecordBatch.from_arrays([b.column(1), pa.ListArray.from_arrays(at, pa.array(flat))], ["good", "x"])


def _adam(gradient, w: np.ndarray, steps: int = STEPS, rate: float = 0.05) -> np.ndarray:
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Model:
    """A linear model on standardised features, fitted on positives p and unlabelled rows u."""

    def __init__(self, p: np.ndarray, u: np.ndarray):
        both = np.concatenate([p, u])
        self.mean, self.scale = both.mean(0), both.std(0) + 1e-4
        p, u = standardise(p, self.mean, self.scale), standardise(u, self.mean, self.scale)
        self.prior = self._prior(p, u)
        self.w = self._risk(p, u, self.prior)

    @staticmethod
    def _prior(p, u):
        odds = _adam(lambda w: -(p.T @ (1 - sigmoid(p @ w))) / len(p) + (u.T @ sigmoid(u @ w)) / len(u) + 2 * PENALTY * w, np.zeros(p.shape[1]))
        sp, su = np.sort(p @ odds), np.sort(u @ odds)
        cuts = sp[np.clip(((1 - REGIONS) * len(sp)).astype(int), 0, len(sp) - 1)]
        ratio = (len(su) - np.searchsorted(su, cuts)) / len(su) / np.maximum((len(sp) - np.searchsorted(sp, cuts)) / len(sp), 1e-9)
        return float(np.clip(ratio.min(), 0.02, 0.98))

    @staticmethod
    def _risk(p, u, prior):
        def gradient(w):
            fp, fu = sigmoid(p @ w), sigmoid(u @ w)
            plus = -(p.T @ (1 - fp)) / len(p) * prior
            excess = np.logaddexp(0, u @ w).mean() - prior * np.logaddexp(0, p @ w).mean()
            minus = (u.T @ fu) / len(u) - prior * (p.T @ fp) / len(p)
            # a negative estimate of the negatives' risk is overfitting: step back from it
            return (plus + minus if excess >= 0 else -minus) + 2 * PENALTY * w

        return _adam(gradient, np.zeros(p.shape[1]))

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(standardise(x, self.mean, self.scale) @ self.w)


def _matrix(rows: list) -> np.ndarray:
    return np.array([r.x for r in rows], np.float64).reshape(len(rows), len(NAMES))


def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> Model | None:
    """The model that scores quality, from at most 1.2 ``SAMPLE`` positives and as many unlabelled rows of (doc_id, text).

    The sample is drawn by a hash of doc_id from ids and labels alone, so only the texts drawn are read for their features.
    """
    learn = F.lit(True) if learn is None else learn
    good = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    ids = docs.where("doc_id is not null").where(learn).select("doc_id").join(good, "doc_id", "left").select("doc_id", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"))
    n = {r.good: r["count"] for r in ids.groupBy("good").count().collect()}
    if not n.get(True):
        return None
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    share = lambda g: int(1_000_000 * min(1.0, SAMPLE / max(1, n.get(g, 0))))
    picked = ids.where(drawn < F.when(F.col("good"), share(True)).otherwise(share(False))).distinct()
    # about SAMPLE ids of each kind at most, so they are broadcast and no text is shuffled
    rows = lambda g: docs.select("doc_id", "text").join(F.broadcast(picked.where(F.col("good") == g)), "doc_id").select("text", "good").mapInArrow(_features, "good boolean, x array<float>")
    p, u = (_matrix(rows(g).limit(int(1.2 * SAMPLE)).collect()) for g in (True, False))
    return Model(p, u if len(u) else p) if len(p) else None


def _score(model):
    """Rows as they come, with a score of the text that is their last column."""

    def run(batches):
        for b in batches:
            m = model.value
            parts = [m.score(x) for _, x, *_ in text_stats(b.column(b.num_columns - 1))] if m else []
            score = np.concatenate(parts) if parts else np.ones(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score)], [*b.schema.names[:-1], "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, score (0 to 1, higher is better).

    ``labels`` gives doc_id and quality (1 is trusted); ``learn`` is a condition on doc_id that rows must meet
    to teach anything. A doc_id with several labels is trusted only if all are 1; null labels and labels of
    absent documents are ignored, and rows without a doc_id teach nothing. Only the text makes the score, so repeated rows and
    ties score alike; a null text counts as empty; texts are read whole, however long. Without trusted rows nothing
    can be learned and every score is 1. An empty table gives an empty result. Only doc_id and text are read.
    """
    source = docs.select(null_safe(docs, "doc_id", "long"), null_safe(docs, "text", "string"))
    sent = docs.sparkSession.sparkContext.broadcast(fit_quality(source, labels, learn))
    return source.mapInArrow(_score(sent), "doc_id long, score double")


def _fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The folds of the registered query: rows whose crc32(doc_id) mod 5 is 0 teach nothing; a null doc_id isn't held out. Edge cases as in ``score_quality``."""
    score = F.round("score", 6)
    return score_quality(docs, labels, _fold() != 0).select("doc_id", F.coalesce(_fold() == 0, F.lit(False)).alias("held_out"), score.alias("score"), (score >= CUT).cast("int").alias("predicted"))


def _keep(model, at: int):
    def run(batches):
        for b in batches:
            m = model.value
            parts = [m.score(x) for _, x, *_ in text_stats(b.column(at))] if m else []
            score = np.concatenate(parts) if parts else np.ones(b.num_rows)
            yield b.filter(pa.array(np.round(score, 6) >= CUT))

    return run


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``CUT``; all their columns, of any names, as they are.

    Each row is decided by its own text, so repeated rows go or stay together and null ids don't matter; a null text
    counts as empty. One pass over the texts beside the bounded sample. Edge cases as in ``score_quality``.
    """
    source = docs.select(null_safe(docs, "doc_id", "long"), null_safe(docs, "text", "string"))
    sent = docs.sparkSession.sparkContext.broadcast(fit_quality(source, labels, _fold() != 0))
    return docs.mapInArrow(_keep(sent, docs.columns.index("text")), docs.schema)
