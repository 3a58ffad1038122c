"""Contextual assertions from cues (A1-A6), and the plug for a learned model."""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import arrow_column
from ..functions.config import ASSERTABLE, FAMILY, HISTORICAL, NEGATED
from ..functions.settings import Settings
from ..functions.text import WS
from .reader import marks_of


def leading_negation(c: Column, settings: Settings = Settings()) -> Column:
    """A5: length of a negation cue at the beginning and the white space after it; 0 for none or an exception."""
    low = F.lower(c)
    longest = sorted((x.lower() for x in settings.cues["isNegated"]), key=lambda x: (-len(x), x))
    exception = F.lit(False)
    for x in settings.cues["negation_exceptions"]:
        exception = exception | low.startswith(x.lower())
    cue = rf"(?U)^(?:{'|'.join(re.escape(x).replace(chr(92) + ' ', ' ') for x in longest)})(?= |\z){WS}*"
    return F.when(exception, 0).otherwise(F.length(F.regexp_extract(low, cue, 0)))


def rule_assertions(raw: Column | str, starts: Column | str, types: Column | str, settings: Settings = Settings(), fuzzy: bool = True) -> Column:
    """E9 as a column: the assertions of a text's concepts, an array for each, from arrays of their starts and types.

    The line of a concept is the last one that begins at or before it; its section is the one open there.
    """
    return arrow_column(lambda texts, at, kinds, kind: marks_of(texts, at, kinds, settings, fuzzy, kind), "array<array<string>>", raw, starts, types)


def add_assertions(concepts: DataFrame, docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Assertions of concepts (doc_id, text, type, start, end) by their line and section in documents (doc_id, raw)."""
    per = concepts.groupBy("doc_id").agg(F.collect_list(F.struct(*[c for c in concepts.columns if c != "doc_id"])).alias("_c"))
    return asserted(docs.select("doc_id", "raw").join(per, "doc_id"), "_c", settings).select(*dict.fromkeys([*concepts.columns, "assertions"]))


def asserted(docs: DataFrame, name: str = "concepts", settings: Settings = Settings()) -> DataFrame:
    """E9 for concepts that stand beside their text in an array: a row for each, doc_id and its fields with the assertions."""
    marks = rule_assertions("raw", F.transform(name, lambda c: c["start"].cast("int")), F.transform(name, lambda c: c["type"]), settings)
    rows = docs.select("doc_id", name, marks.alias("_a")).select("doc_id", F.explode(F.arrays_zip(F.col(name).alias("c"), F.col("_a").alias("a"))).alias("x"))
    own = [f for f in docs.schema[name].dataType.elementType.names if f != "assertions"]
    return rows.select("doc_id", *[F.col(f"x.c.{f}") for f in own], F.col("x.a").alias("assertions"))


def model_assertions(concepts: DataFrame, predict: Callable, threshold: float = 0.5) -> DataFrame:
    """Replace the assertions of assertable rows by a model's.  ``predict`` is an Arrow or pandas function of the marked
    text (column ``marked``) that returns array<double> for negated, historical, family; it is injected, no model ships."""
    p = F.when(F.col("type").isin(ASSERTABLE), predict(F.col("marked")))
    chosen = F.array_compact(F.array(*[F.when(F.get(p, i) >= threshold, a) for i, a in enumerate((NEGATED, HISTORICAL, FAMILY))]))
    return concepts.withColumn("assertions", F.when(F.col("type").isin(ASSERTABLE), chosen).otherwise(F.col("assertions")))
