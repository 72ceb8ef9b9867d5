"""Scores of dense, sparse and fused ranking. All constants are doubles, so that no decimal arithmetic creeps in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null if a vector has no length."""
    lengths = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(lengths > 0, dot(a, b) / lengths)


def idf(texts: Column, with_term: Column) -> Column:
    n, df = texts.cast("double"), with_term.cast("double")
    return F.ln((n - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))


def saturation(tf: Column, length: Column, k1: float, b: float, average: float) -> Column:
    t, n = tf.cast("double"), length.cast("double")
    return t * F.lit(k1 + 1.0) / (t + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * n / F.lit(average)))


def reciprocal_rank(rank: Column, k: int) -> Column:
    """rank counts from 0."""
    return F.lit(1.0) / (F.lit(float(k)) + rank.cast("double"))
