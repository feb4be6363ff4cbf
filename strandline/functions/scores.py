"""Scores and rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.5, 0.75
RRF_K = 60
Z = 1.96


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def bm25_weight(idf_: Column, tf: Column, length: Column, average: Column) -> Column:
    return idf_ * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def wilson_lower(positive: Column, n: Column) -> Column:
    """Lower bound of the share of positives with 95 % confidence; 0.5 without any."""
    p = positive / n
    centre = p + Z * Z / (2 * n)
    spread = Z * F.sqrt((p * (1 - p) + Z * Z / (4 * n)) / n)
    return F.when(n > 0, (centre - spread) / (1 + Z * Z / n)).otherwise(F.lit(0.5))


def learned_score(base: Column, positive: Column, n: Column) -> Column:
    """A base score that gives way to twice the Wilson bound as ratings grow."""
    trust = F.least(F.lit(1.0), F.log(n + 1) / F.log(F.lit(20.0)))
    return F.when(n > 0, base * (1 - trust) + 2 * wilson_lower(positive, n) * trust).otherwise(base)


def mapping_confidence(positive: Column, n: Column) -> Column:
    """Share of successes, and up to 0.2 for their number; 0.5 without any."""
    return F.when(n > 0, F.least(F.lit(1.0), positive / n + F.least(n / 10, F.lit(1.0)) * 0.2)).otherwise(F.lit(0.5))


def metadata_boost(importance: Column, warning: Column, procedure: Column, hits: Column) -> Column:
    return F.when(importance >= 0.8, 1.3).otherwise(1.0) * F.when(warning, 1.2).otherwise(1.0) * F.when(procedure, 1.15).otherwise(1.0) * (1 + 0.1 * hits)


def context_score(similarity: Column, importance: Column, warning: Column, procedure: Column, overlap: Column) -> Column:
    return 0.4 * similarity + 0.3 * importance + 0.15 * warning.cast("int") + 0.1 * procedure.cast("int") + 0.05 * overlap


def sufficiency(average: Column, top: Column, n: Column) -> Column:
    return 0.5 * F.least(average / 0.5, F.lit(1.0)) + 0.3 * F.least(top / 0.6, F.lit(1.0)) + 0.2 * F.least(n / 3, F.lit(1.0))


def recommendation(score: Column) -> Column:
    return F.when(score >= 0.7, "answer").when(score >= 0.4, "caution").otherwise("refuse")


def rate(part: Column, whole: Column) -> Column:
    """Per cent to one digit; 0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part * 100.0 / whole, 1))


def ban_minutes(attempts: Column) -> Column:
    return F.when(attempts >= 15, 1440).when(attempts >= 10, 60).when(attempts >= 5, 15).otherwise(0)


def grade(overlap: Column) -> Column:
    return F.when(overlap >= 0.15, "good").when(overlap >= 0.07, "partial").otherwise("fail")


def is_empty(value: Column) -> Column:
    """Null, or one of the spellings of nothing."""
    return value.isNull() | F.trim(value.cast("string")).isin("", "-", "N/A", "Unknown")
