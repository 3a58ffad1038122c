"""The pipeline's stages on a small corpus: what goes, what stays, what is repeated."""
import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from medlattice.llm import neardup
from tests.llm.test_models import text_of


def test_stages(spark):
    rng = random.Random(12)
    texts = [(i, text_of(rng, lang, 60), lang, "hot" if i % 3 else f"s{i % 5}", 0) for i, lang in enumerate(rng.choices(["en", "fr", "de"], k=90))]
    near = texts[5][1].split()
    near[30] = "anders"
    texts += [(100, texts[4][1], "en", "hot", 0), (101, " ".join(near), "en", "hot", 0), (102, None, "en", "hot", 0), (103, "123", None, "hot", 0), (0, texts[0][1], texts[0][2], "hot", 0)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    one = corpus_pipeline.language_id(spark, docs, "")
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} == {i for i, *_ in texts} - {102, 103}
    two = corpus_pipeline.near_dedup(spark, one, "")
    assert sorted(r["doc_id"] for r in two.collect()) == list(range(90)) and two.columns == docs.columns
    three = corpus_pipeline.mix(spark, two, "")
    n = three.groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    assert len(n) == 90 and max(r["n"] for r in n) == 2
    last = corpus_pipeline.tokenise(spark, three, "")
    assert last.count() == three.count() and last.where("n_tokens <> size(ids)").count() == 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
    assert empty.count() == 0


def test_unlabelled_rows_stay(spark):
    rng = random.Random(22)
    rows = [(i, text_of(rng, ("en", "fr")[i % 2], 60), ("en", "fr")[i % 2], "hot", 0) for i in range(40)]
    docs = spark.createDataFrame([*rows, (40, "12 34", None, "hot", 0), (41, None, None, "hot", 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    none = corpus_pipeline.language_id(spark, docs.withColumn("lang", F.lit(None).cast("string")), "")
    assert sorted((r["doc_id"], r["text"], r["lang"]) for r in none.collect()) == [(i, t, None) for i, t, *_ in rows]
    some = corpus_pipeline.language_id(spark, docs.withColumn("lang", F.when(F.col("doc_id") < 30, F.col("lang"))), "")
    assert sorted((r["doc_id"], r["lang"]) for r in some.collect()) == [(i, lang) for i, _, lang, *_ in rows]


def test_rows_without_an_id_stay(spark):
    rng = random.Random(21)
    own = [text_of(rng, "en", 60) for _ in range(6)]
    edited = lambda t, w: " ".join([*t.split()[:30], w, *t.split()[31:]])
    rows = [(1, own[0]), (None, own[1]), (None, own[2]), (None, edited(own[2], "anders")), (None, own[2]), (2, own[3]), (None, edited(own[3], "anders")), (3, own[4]), (3, own[5]), (None, None)]
    docs = spark.createDataFrame([(*r, "en", "hot", 0) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    found = {r["text_key"]: r for r in neardup.classes(docs).collect()}
    key = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    assert [found[key[t]]["class_texts"] for t in (own[1], own[2], rows[3][1], rows[6][1])] == [1, 2, 2, 2]
    assert found[key[rows[6][1]]]["dup_class"] == 2 and found[key[own[1]]]["dup_class"] is None
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    third = [r for r in got if r in (rows[2], rows[3])]
    assert len(third) == 1
    assert sorted(got, key=str) == sorted([rows[0], rows[1], *third, rows[5], rows[7], rows[8], rows[9]], key=str)


def test_shingles_are_of_five_words():
    a = neardup.shingles(neardup.word_hashes("a b c d e f".split()))
    b = neardup.shingles(neardup.word_hashes("b c d e f".split()))
    assert len(a) == 2 and np.array_equal(a[1:], b)
