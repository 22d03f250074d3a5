"""Similarity of strings and of sets of words."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / length of the longer; 0 if either is empty."""
    return F.when((a == "") | (b == ""), 0.0).otherwise(1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def overlap(a: Column, b: Column) -> Column:
    """Common elements over the size of the smaller set; 0 if either is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


@lru_cache(maxsize=1 << 16)
def jaro_winkler_value(a: str, b: str) -> float:
    """Jaro similarity, raised by 0.1 for each of up to four common first characters where it is over 0.7."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = [True] * len(b)
    left = []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if free[j] and b[j] == c), -1)
        if j >= 0:
            free[j] = False
            left.append(c)
    if not left:
        return 0.0
    right = [c for j, c in enumerate(b) if not free[j]]
    m, moved = len(left), sum(x != y for x, y in zip(left, right)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    if jaro <= 0.7:
        return jaro
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return jaro + 0.1 * same * (1 - jaro)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    # names repeat over the pairs of a query, and each different pair is compared once for as long as it is remembered
    return pd.Series([jaro_winkler_value(x or "", y or "") for x, y in zip(a, b)])
