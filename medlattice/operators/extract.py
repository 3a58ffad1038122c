"""Rule extraction of typed concepts (E1-E8), one pass a document.

Concept rows are doc_id, ord, text, type, start, end, assertions, candidates; every one satisfies
substring(raw, start, end) = text.  ``concepts`` is the same as an array beside the document, so that what needs the text and
its concepts together reads the documents once and shuffles nothing.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import arrow_column
from ..functions.settings import Settings
from .reader import CONCEPTS, concepts_of


def concepts(raw: Column | str, settings: Settings = Settings(), fuzzy: bool = True, types: list[str] | None = None) -> Column:
    """All concepts of a text (of ``types`` only, if given) as an array in document order."""
    return arrow_column(lambda texts, kind: concepts_of(texts, settings, fuzzy, types, kind), CONCEPTS, raw)


def annotate(docs: DataFrame, settings: Settings = Settings(), fuzzy: bool = True) -> DataFrame:
    """Documents (doc_id, raw and others) with their concepts."""
    return docs.withColumn("concepts", concepts("raw", settings, fuzzy))


def flat(annotated: DataFrame) -> DataFrame:
    """Concept rows of documents with concepts."""
    return annotated.select("doc_id", F.explode("concepts").alias("c")).select("doc_id", "c.*")


def extract(docs: DataFrame, settings: Settings = Settings(), fuzzy: bool = True, types: list[str] | None = None) -> DataFrame:
    """All concepts of documents (doc_id, raw), in document order within ``ord``."""
    return flat(docs.select("doc_id", concepts("raw", settings, fuzzy, types).alias("concepts")))


def beside(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Documents with the concept rows of a table (doc_id, ord and others) as an array in order of ``ord``, as ``annotate`` has them."""
    own = [c for c in rows.columns if c not in ("doc_id", "ord")]
    per = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", *own))).alias("concepts"))
    return docs.drop("concepts").join(per, "doc_id", "left").withColumn("concepts", F.coalesce("concepts", F.array().cast(per.schema["concepts"].dataType)))
