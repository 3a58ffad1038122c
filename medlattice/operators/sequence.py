"""Sequence labelling around a token model (Q1-Q5, Q7, Q8); the model itself is injected."""
from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.config import TYPES
from .sections import line_table, packed

#: Label 0 is O; then B and I of each type in order.
LABELS = ["O"] + [f"{p}-{t}" for t in TYPES for p in ("B", "I")]
IGNORED = -100
_RUNS = 512


def label_name(label_id: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in LABELS]), label_id), F.lit("O"))


def bio_decode(tokens: DataFrame) -> DataFrame:
    """Q1: tokens (doc_id, i, label_id, a, b, conf) to spans (doc_id, start, end, type, conf) by gaps and islands.

    Zero-width tokens are skipped; O ends a span; B, another type or an orphan I begins one.
    """
    rows = tokens.where("a <> b").withColumn("name", label_name(F.col("label_id"))).withColumn("type", F.when(F.col("name") != "O", F.substring("name", 3, 100)))
    w = Window.partitionBy("doc_id").orderBy("i")
    begins = F.col("type").isNotNull() & (F.col("name").startswith("B-") | ~F.col("type").eqNullSafe(F.lag("type").over(w)))
    rows = rows.withColumn("island", F.sum(begins.cast("int")).over(w)).where("type is not null")
    spans = rows.groupBy("doc_id", "island").agg(F.min_by("a", "i").alias("start"), F.max_by("b", "i").alias("end"), F.first("type").alias("type"), F.avg("conf").alias("conf"))
    return spans.select("doc_id", "start", "end", "type", "conf")


def bio_encode(tokens: DataFrame, concepts: DataFrame) -> DataFrame:
    """Q2: tokens (doc_id, i, a, b) with label_id: the last concept (by ord) that overlaps a token labels it, B on its first one."""
    ids = F.create_map(*[F.lit(x) for i, n in enumerate(LABELS) for x in (n, i)])
    hit = tokens.where("a <> b").join(concepts.select("doc_id", "ord", "type", "start", "end"), "doc_id").where("a < end and b > start")
    first = F.min("i").over(Window.partitionBy("doc_id", "ord")) == F.col("i")
    best = hit.withColumn("first", first).groupBy("doc_id", "i").agg(F.max_by(F.struct("type", "first"), "ord").alias("c"))
    name = F.concat(F.when(F.col("c.first"), F.lit("B-")).otherwise(F.lit("I-")), F.col("c.type"))
    label = F.when(F.col("a") == F.col("b"), IGNORED).when(F.col("c").isNotNull(), F.element_at(ids, name)).otherwise(0)
    return tokens.join(best, ["doc_id", "i"], "left").select(*tokens.columns, label.alias("label_id"))


def chunk_lines(docs: DataFrame, max_len: int, n_tokens: Callable[[Column], Column] | None = None) -> DataFrame:
    """Q3: doc_id, chunk, start, end: lines packed while their tokens stay within max(8, max_len - 2); a longer line is alone."""
    budget = max(8, max_len - 2)
    count = n_tokens or (lambda c: F.size(F.filter(F.split(c, r"(?U)\s+"), lambda t: t != "")))
    lines = line_table(docs, whole=True).where("size > 0")
    end = F.coalesce(F.lead("line_start").over(Window.partitionBy("doc_id").orderBy("line_no")), F.col("size")).cast("int")
    line = F.struct(F.col("line_start").alias("start"), "end", count(F.col("line")).cast("int").alias("n"))
    per = lines.withColumn("end", end).groupBy("doc_id").agg(F.array_sort(F.collect_list(line)).alias("x"))
    cut = packed(F.col("x"), lambda run, x: run["n"] + x["n"] <= budget)
    return per.select("doc_id", F.posexplode(cut).alias("chunk", "c")).select("doc_id", "chunk", "c.start", "c.end")


def predict_spans(docs: DataFrame, max_len: int, predict: Callable[[DataFrame], DataFrame], min_prob: float = 0.0) -> DataFrame:
    """Q4: chunk, let ``predict`` turn (doc_id, chunk, text) into tokens (doc_id, chunk, i, label_id, a, b, conf), decode, rebase, filter."""
    chunks = chunk_lines(docs, max_len).join(docs.select("doc_id", "raw"), "doc_id")
    texts = chunks.select("doc_id", "chunk", "start", F.substring(F.col("raw"), F.col("start") + 1, F.col("end") - F.col("start")).alias("text"))
    tokens = predict(texts.select("doc_id", "chunk", "text"))
    spans = bio_decode(tokens.withColumn("doc_id", F.struct("doc_id", "chunk"))).select("doc_id.doc_id", "doc_id.chunk", F.col("start").alias("s"), F.col("end").alias("e"), "type", "conf")
    out = spans.join(texts, ["doc_id", "chunk"]).withColumn("t", F.substring(F.col("text"), F.col("s") + 1, F.col("e") - F.col("s")))
    return out.where((F.trim("t") != "") & (F.col("conf") >= min_prob)).select("doc_id", F.col("t").alias("text"), "type", (F.col("s") + F.col("start")).alias("start"), (F.col("e") + F.col("start")).alias("end"), "conf")


def fixed_blocks(tokens: DataFrame, block: int) -> DataFrame:
    """Q5: tokens (doc_id, i, token) in order, cut into blocks of ``block``; the remainder goes, but a short corpus is one short block.

    ``doc_id`` is numeric and gives the order.  Global numbers come from two levels of counts: over ``_RUNS`` ranges of ids of
    like size, of which the driver sees one number each, and within a range by a window.
    """
    counts = tokens.groupBy("doc_id").agg(F.count("*").alias("n"))
    bounds = counts.select(F.percentile_approx("doc_id", [i / _RUNS for i in range(1, _RUNS)], 20 * _RUNS)).first()[0]
    bounds = sorted(set(bounds or []))
    run = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col("doc_id"))) if bounds else F.lit(0)
    counts = counts.withColumn("run", run)
    sizes = dict(sorted(tuple(r) for r in counts.groupBy("run").agg(F.sum("n")).collect()))
    before = dict(zip(sizes, itertools.accumulate(sizes.values(), initial=0)))
    at = sum(sizes.values())
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("run").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("run")).cast("bigint") if before else F.lit(0).cast("bigint")
    offsets = counts.select("doc_id", (base + inside).alias("base"))
    whole = max(at // block * block, min(at, block))
    w = Window.partitionBy("doc_id").orderBy("i")
    placed = tokens.withColumn("k", F.row_number().over(w) - 1).join(offsets, "doc_id").withColumn("pos", F.col("base") + F.col("k")).where(F.col("pos") < whole)
    return placed.groupBy(F.expr(f"pos div {block}").alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("tokens"))


def concat_training(*sets: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Q7: the union of the sets that exist, and concepts per type."""
    out = None
    for s in sets:
        if s is not None:
            out = s if out is None else out.unionByName(s)
    return out, out.select(F.explode("concepts").alias("c")).groupBy(F.col("c.type").alias("type")).agg(F.count("*").alias("n"))


def subset(labelled: DataFrame, order: str, n: int) -> DataFrame:
    """Q8: the first ``n`` rows."""
    return labelled.orderBy(order).limit(n)
