"""Token-sort similarity (L13): 100 * 2 * LCS / (len a + len b) over the sorted, joined tokens."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from .text import words


def token_sort(c: Column) -> Column:
    """White-space tokens in order, joined by one space."""
    return F.array_join(F.array_sort(words(c)), " ")


def lcs(a: str, b: str) -> int:
    """Longest common subsequence, a machine word of rows at a time."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        if m := masks.get(ch):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200.0 * lcs(a, b) / total if total else 100.0


@pandas_udf(DoubleType())
def sorted_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two token-sorted columns, an Arrow batch at a time."""
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def token_sort_ratio(a: Column, b: Column) -> Column:
    return sorted_ratio(token_sort(a), token_sort(b))


def register(spark) -> None:
    """The SQL function token_sort_ratio over token-sorted strings."""
    spark.udf.register("sorted_ratio", sorted_ratio)
