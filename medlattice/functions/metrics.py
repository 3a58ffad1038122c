"""Scoring primitives as columns (M1-M4)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import words


def edit_distance(a: Column, b: Column) -> Column:
    """M1: unit-cost Levenshtein distance of two arrays; the row of costs is folded over ``a``."""
    start = F.sequence(F.lit(0), F.size(b))

    def row(prev: Column, x: Column) -> Column:
        init = F.struct(F.array(F.get(prev, 0) + 1).alias("row"), F.lit(0).alias("j"))

        def cell(acc, y):
            j = acc["j"]
            cost = F.when(x == y, 0).otherwise(1)
            best = F.least(F.get(prev, j + 1) + 1, F.get(acc["row"], j) + 1, F.get(prev, j) + cost)
            return F.struct(F.concat(acc["row"], F.array(best)).alias("row"), (j + 1).alias("j"))

        return F.aggregate(b, init, cell, lambda acc: acc["row"])

    return F.element_at(F.aggregate(a, start, row), -1)


def wer(ref: Column, hyp: Column, lower: bool = False) -> Column:
    """M2: word error rate, unbounded; an empty reference gives 0 or 1."""
    r, h = words(ref, lower), words(hyp, lower)
    return F.when(F.size(r) == 0, F.when(F.size(h) == 0, 0.0).otherwise(1.0)).otherwise(edit_distance(r, h) / F.size(r))


def jaccard(gold: Column, pred: Column) -> Column:
    """M3: of two arrays as sets; two empty sets agree, one empty set scores 0."""
    union = F.size(F.array_union(gold, pred))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(gold, pred)) / union)


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """M4."""
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
