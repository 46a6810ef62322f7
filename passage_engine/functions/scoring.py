"""Scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Constants of BM25, of reciprocal rank fusion and of the weight of dense hits in convex fusion.
K1, B, IDF_FLOOR, RRF_K, DENSE_WEIGHT = 1.2, 0.75, 1e-6, 60, 0.3


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision, from the first component on."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length; 1 for a zero vector, whose cosine is then 0."""
    n = F.sqrt(dot(a, a))
    return F.when(n == 0, F.lit(1.0)).otherwise(n)


def l2_normalize(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") / norm(a))


def bm25_idf(n: Column, df: Column) -> Column:
    """ln((N - df + 0.5) / (df + 0.5)), at least a millionth."""
    idf = F.ln((n - df + 0.5) / (df + 0.5))
    return F.when(idf <= 0, F.lit(IDF_FLOOR)).otherwise(idf)


def bm25_part(idf: Column, tf: Column, length: Column, mean_length: Column) -> Column:
    """One term's part of a BM25 score."""
    return idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * length / mean_length))


def coverage_idf(n: Column, df: Column) -> Column:
    """ln(1 + (N - df + 0.5) / (df + 0.5)), never negative."""
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def level(score: Column) -> Column:
    """A score in steps of 1e-9, as a whole number to sort by: scores that differ by rounding alone are one level."""
    return F.floor(score * 1e9 + 0.5)


def minmax(score: Column, *by: str) -> Column:
    """Scores of a group brought to 0..1; 1 where all are equal; null stays null."""
    group = W.partitionBy(*by)
    low, high = F.min(score).over(group), F.max(score).over(group)
    return F.when(score.isNull(), F.lit(None)).when(high == low, F.lit(1.0)).otherwise((score - low) / (high - low))


def convex(dense: Column, sparse: Column, weight: float = DENSE_WEIGHT) -> Column:
    """weight * dense + (1 - weight) * sparse of normalised scores; a missing side is 0."""
    return weight * F.coalesce(dense, F.lit(0.0)) + (1 - weight) * F.coalesce(sparse, F.lit(0.0))


def rrf(*ranks: Column) -> Column:
    """Reciprocal rank fusion: the sum of 1 / (60 + rank) over the lists that hold an item."""
    return sum((F.coalesce(1 / (RRF_K + r), F.lit(0.0)) for r in ranks), F.lit(0.0))


def relative(score: Column, *by: str) -> Column:
    """Scores as shares of their group's largest one; 0 where that is not positive."""
    most = F.max(score).over(W.partitionBy(*by))
    return F.when(most > 0, F.coalesce(score, F.lit(0.0)) / most).otherwise(F.lit(0.0))
