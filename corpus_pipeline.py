"""From raw documents to a tokenised training corpus: four stages, each written as Parquet and read again by the next.

1. language_id  drops the documents that the mixture inference rejects, those without letters; where lang is null it becomes
                the predicted language, if any row is labelled.
2. near_dedup   keeps one document, that of the least doc_id (null last), of each class of near-duplicates.
3. mix          repeats the documents of smaller sources by temperature; every document stays at least once.
4. bpe          encodes every whole text.

All stages take documents with doc_id, text, lang and source in any state: null values, empty and very long texts, repeated
rows, other columns of any name, and empty tables; each docstring says what becomes of them.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medlattice.llm import bpe, langid, mixing, neardup
from medlattice.llm.queries import TOKENIZER
from medlattice.llm.shared import free_name, shared_table


def _own(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters; a null lang is filled with the prediction, other columns and labels are left as they are.

    A null or empty text has no letters and goes.  Without any labelled row nothing is predicted, and lang stays null.
    Texts of any length are read whole; repeated rows and null ids are decided alike; ties go to the language that the
    operator prefers; columns with the names of predictions stay as they are; an empty table gives no rows.
    """
    model = langid.train(docs.where("lang is not null"))
    if not model.langs:
        return langid.with_letters(docs)
    told = langid.predict(docs, model, docs.columns)
    pred = F.col(free_name("lang_pred", docs.columns))
    return told.where(pred != "und").select(*[F.coalesce(F.col("lang"), pred).alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, found by its doc_id and text, so no class is lost where ids are null or stand for several texts.

    Rows with null texts all stay; equal texts, the empty one too, are one class; of repeated rows, equal in doc_id and
    text, one stays, any if they differ in other columns; ties go to the least doc_id, then the least text; very long texts
    are compared whole; other columns are carried along whatever their names; an empty table gives no rows.
    """
    found = neardup.classes(docs)
    keep = shared_table(found.where("kept").groupBy("doc", "text_key").agg(F.count("*").alias("n")), "pipeline-kept")
    same = docs["doc_id"].cast("bigint").eqNullSafe(keep["doc"]) & (F.xxhash64(docs["text"]) == keep["text_key"])
    once = docs.join(keep.where("n = 1"), same, "left_semi")
    again = docs.join(keep.where("n > 1"), same, "left_semi").dropDuplicates(["doc_id", "text"])  # only rows that are repeated move here
    return once.unionByName(again).unionByName(docs.where("text is null"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks for, at least once.

    A null source is a source of its own; null or empty texts and null ids are taken like others; repeated rows are taken
    alike; very long texts count with all their words; other columns stay as they are; an empty table gives no rows.
    """
    return mixing.mix(docs).select(*_own(docs))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and their digests, a row for each taken document.

    A null or empty text has no ids; very long texts are streamed; repeated rows and null ids give equal rows; other
    columns are not read; an empty table gives no rows.
    """
    return bpe.encode(docs, TOKENIZER, ["doc_id", "source"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("language_id", language_id), ("near_dedup", near_dedup), ("mix", mix), ("bpe", tokenise)]

#: Models, sketches and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
