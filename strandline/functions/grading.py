"""Scores of answers against expected ones."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of two word lists, by bit-parallel rows (Hyyrö, 2004)."""
    if len(a) > len(b):
        a, b = b, a
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & at.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


@F.pandas_udf(DoubleType())
def rouge_l(expected: pd.Series, actual: pd.Series) -> pd.Series:
    """F1 of the longest common subsequence of two token arrays, to four digits; 0 where one is empty or null."""

    def one(e, a) -> float:
        if e is None or a is None or not len(e) or not len(a):
            return 0.0
        n = common_length(list(e), list(a))
        p, r = n / len(a), n / len(e)
        return float(np.round(2 * p * r / (p + r), 4)) if n else 0.0

    return pd.Series([one(e, a) for e, a in zip(expected, actual, strict=True)], dtype="float64")


def cites_source(text: Column, words: list[str]) -> Column:
    """Whether a text names one of the words that tell a source."""
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(text), w))


def codes(text: Column) -> Column:
    """Error codes of a text, in upper case."""
    return F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit("[EW][0-9]{3,4}"), F.lit(0)))


def invented_codes(actual: Column, expected: Column) -> Column:
    """Whether the answer names codes, none of which is expected."""
    return (F.size(codes(actual)) > 0) & ~F.arrays_overlap(codes(actual), codes(expected))
