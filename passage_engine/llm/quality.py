"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Every whole text gives a vector of transformed statistics (shares of character kinds, repetition, lengths). Per class,
the count, the sum and the sum of outer products of the labelled vectors are added up by Spark, one short row per class
and task, so the fit sees every labelled training row and only a matrix per task moves. A class covariance is shrunk
towards the pooled one and towards its diagonal, factored once by Cholesky, and a text's score is the logistic of the
difference of the classes' log densities (Mahalanobis distance by the cached factor, log determinant, log prior).

Labels, language, source and ids are no inputs of the score.

Defined results: a null or empty text has the statistics of an empty text and a score like any other; repeated rows each
get their own row; a training set without a class gives that class its only neighbour's share, so scores are all 0 or
all 1, and one without rows gives 0.5; labels other than 0 and 1 or null are not learnt from; several labels of one
document each count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passage_engine import session
from passage_engine.llm.batches import per_document

#: Parts of a class covariance taken from the pooled covariance and from the diagonal, and the least variance.
POOLED, DIAGONAL, FLOOR = 0.05, 0.05, 0.03
#: Words and letters added to what shares are of.
LEAST_WORDS, LEAST_LETTERS = 16, 96

_UPPER, _LOWER, _DIGIT, _SPACE = (np.frombuffer(s, np.uint8) for s in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\n\r\f\v"))
_PLAIN = np.frombuffer(b".,;:'\"-()", np.uint8)


def statistics(text: str) -> list[float]:
    """Statistics of a whole text, each transformed to spread its small values: log(1 + 40 share).

    Shares are of a few words or letters more than the text has, so that one or two words say little by themselves.
    """
    words = text.split()
    n_words = len(words) + LEAST_WORDS
    counts = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    size = int(counts.sum()) + LEAST_LETTERS
    upper, lower, digit, space = (int(counts[k].sum()) for k in (_UPPER, _LOWER, _DIGIT, _SPACE))
    beyond, plain = int(counts[128:].sum()), int(counts[_PLAIN].sum())
    letters = upper + lower + beyond
    marks = size - LEAST_LETTERS - letters - digit - space - plain
    distinct = len(set(words))
    shares = (
        marks / size,
        upper / (letters + LEAST_LETTERS),
        digit / size,
        int(counts[124]) / n_words,  # the vertical bar
        int(counts[33]) / n_words,  # the exclamation mark
        sum(map(eq, words, islice(words, 1, None))) / n_words,
        plain / n_words,
    )
    return [
        *(math.log1p(40 * x) for x in shares),
        math.log1p(distinct + LEAST_WORDS) / math.log1p(n_words),
    ]


NAMES = ("marks", "upper", "digits", "bars", "exclamations", "repeats", "plain_marks", "distinct")


@dataclass(frozen=True)
class Discriminant:
    """Fitted classes: log prior, mean and inverse Cholesky factor of each, with its log determinant."""

    log_prior: tuple[float, float]
    means: np.ndarray
    inverse: np.ndarray
    log_det: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        if not all(map(math.isfinite, self.log_prior)):
            return np.full(len(x), 0.5 if self.log_prior[0] == self.log_prior[1] else float(self.log_prior[1] == 0.0))
        density = [self.log_prior[k] - 0.5 * (((x - self.means[k]) @ self.inverse[k].T) ** 2).sum(1) - 0.5 * self.log_det[k] for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def discriminant(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], d: int = len(NAMES)) -> Discriminant:
    """From each class's count, sum and sum of outer products."""
    none = (0.0, np.zeros(d), np.zeros((d, d)))
    n, total, outer = zip(*(moments.get(k, none) for k in (0, 1)), strict=True)
    rows = sum(n)
    prior = tuple(math.log(k / rows) if k else -math.inf for k in n) if rows else (-math.inf, -math.inf)
    means = np.array([t / max(k, 1) for k, t in zip(n, total, strict=True)])
    scatter = [o - k * np.outer(m, m) for k, o, m in zip(n, outer, means, strict=True)]
    pooled = sum(scatter) / max(rows, 1)
    inverse, log_det = [], []
    for k in (0, 1):
        own = (1 - POOLED) * scatter[k] / max(n[k], 1) + POOLED * pooled
        own = (1 - DIAGONAL) * own + DIAGONAL * np.diag(np.diag(own)) + FLOOR * np.eye(d)
        factor = np.linalg.cholesky(own)
        inverse.append(np.linalg.inv(factor))
        log_det.append(2 * np.log(np.diag(factor)).sum())
    return Discriminant(prior, means, np.array(inverse), np.array(log_det))


def document_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id and the statistics of its whole text. No shuffle."""
    return per_document(docs, lambda texts: {"stats": [np.array(statistics(t)).tobytes() for t in texts]}, "stats binary", doc_id, text)


def fit(labelled: DataFrame, label: str = "label") -> Discriminant:
    """Learns from every row of statistics (``stats``) whose label is 0 or 1."""
    d = len(NAMES)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros(1 + d + d * d) for k in (0, 1)}
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(0).to_pylist())).reshape(-1, d)
            y = np.array(batch.column(1).to_pylist())
            for k, s in sums.items():
                own = x[y == k]
                s += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_pydict({"label": list(sums), "sums": [s.tolist() for s in sums.values()]}, pa.schema([("label", pa.int32()), ("sums", pa.list_(pa.float64()))]))

    pairs = labelled.select("stats", F.col(f"`{label}`").cast("int").alias("label")).where("label in (0, 1)")
    parts = pairs.mapInArrow(moments, "label int, sums array<double>")
    # One number per class and place: the driver gets 2 * (1 + d + d * d) of them, however many tasks there are.
    total = parts.select("label", F.posexplode("sums").alias("place", "x")).groupBy("label", "place").agg(F.sum("x").alias("x")).collect()
    found = {k: np.zeros(1 + d + d * d) for k in (0, 1)}
    for row in total:
        found[row["label"]][row["place"]] = row["x"]
    return discriminant({k: (s[0], s[1 : 1 + d], s[1 + d :].reshape(d, d)) for k, s in found.items()})


def score_column(model: Discriminant):
    """A function of a text column: the probability of class 1."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.array([statistics(t or "") for t in texts]).reshape(-1, len(NAMES))))

    return score


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows whose labels are never learnt from: crc32 of the id's text, modulo 3, is 1."""
    return F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 3 == 1


def _trained(docs: DataFrame, labels: DataFrame, doc_id: str, text: str) -> tuple[Discriminant, DataFrame]:
    """The model and the statistics of every document; only statistics move to the labels, never texts."""
    path = session.scratch(docs.sparkSession, "quality-statistics")
    document_statistics(docs, doc_id, text).write.parquet(path)
    stats = docs.sparkSession.read.parquet(path)
    known = labels.select(F.col("doc_id").alias("label_id"), F.col("quality").alias("label")).where(~held_out("label_id") & F.col("label").isin(0, 1))
    return fit(stats.join(known, stats.doc_id == known.label_id).select("stats", "label")), stats


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Discriminant:
    """Fits on the labelled rows that are not held out."""
    return _trained(docs, labels, doc_id, text)[0]


def train_and_score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fits on the labelled rows that are not held out and scores every document: doc_id, held_out, score, predicted."""
    model, stats = _trained(docs, labels, doc_id, text)

    @F.pandas_udf("double")
    def score(rows: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.frombuffer(b"".join(rows)).reshape(-1, len(NAMES))))

    scored = stats.select("doc_id", score("stats").alias("score"))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
