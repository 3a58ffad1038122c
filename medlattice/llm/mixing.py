"""Mixing sources to target weights by temperature.

Each source's share of the tokens is raised to an exponent between 0 (equal sources) and 1 (as they are) and
normalised.  The exponent is the largest, found by bisection, that meets the target: an entropy of the weights of at
least ``min_entropy`` (a share of the largest possible), or, the default, the smallest that repeats no source more than
``max_repeat`` times as often as the least repeated.  The budget is by default the least that takes every document at
least once, so nothing is dropped; a smaller budget takes a part of the larger sources.

Weights are realised as budgeted block permutations: a source's documents are hashed into blocks of about ``BLOCK_ROWS``,
however many that makes; each pass over the source has its own permutation of them, the order of a hash of block and
pass; whole blocks are taken until the source's budget is met, the last one if that comes nearer.  ``mix_at`` places each
taken document in the whole mixture, in proportion to its source's progress, a block's documents one after the other.

Scale: documents are never moved or joined with blocks.  Whether a block is taken follows from its place in the permutation
and one cut a source, which ``cuts.weighted_cuts`` finds from histograms of a slim table (source, hash, tokens); progress is
read from a table of at most about ``CELLS`` sums, interpolated within a cell.  Texts are read twice, once to count their
words.  The driver sees one row per source, at most ``MAX_SOURCES`` (more is an error).

Defined results: a null source is a source of its own; null or empty texts have no tokens and go with their blocks;
sources without tokens are taken once; null ids are told apart by their texts; very long texts count with all their words;
repeated rows, equal in id and text, are taken alike; equal places (ties of the hash) are taken or left together; an empty
table gives no rows; input columns stay as they are, and where one has the name of a result, the result's name gets
underscores (``free_name``).
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cuts import weighted_cuts
from .shared import free_name, shared_table

BLOCK_ROWS, MAX_SOURCES, SEED = 64, 10_000, 17
#: Sums of progress over all sources and passes: at most about so many rows of 40 bytes are broadcast.
CELLS = 1 << 20
#: Places of a permutation, and of a document within its block.
PLACES, INSIDE = 1 << 36, 1 << 16


def weights(tokens: list[float], exponent: float) -> list[float]:
    total = sum(tokens)
    raw = [(t / total) ** exponent if t else 0.0 for t in tokens]
    return [r / sum(raw) for r in raw]


def bisect_exponent(tokens: list[float], max_repeat: float | None = 2.0, min_entropy: float | None = None) -> float:
    """The exponent in [0, 1] at which the target is just met; both bounds are met by their monotone side."""
    own = [t for t in tokens if t]
    if len(own) < 2:
        return 1.0
    if min_entropy is not None:
        goal = min_entropy * math.log(len(own))
        fits = lambda a: -sum(w * math.log(w) for w in weights(own, a)) >= goal  # noqa: E731  more even for a smaller exponent
        if fits(1.0):
            return 1.0
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if fits(mid) else (low, mid)
        return low
    spread = lambda a: max(w / t for w, t in zip(weights(own, a), own)) / min(w / t for w, t in zip(weights(own, a), own))
    if spread(0.0) <= max_repeat:
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if spread(mid) <= max_repeat else (mid, high)
    return high


def n_tokens(text: str):
    """Words between white space, counted without splitting."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0)).cast("bigint")


def _order(source: Column, block: Column, turn: Column) -> Column:
    """A block's place in the permutation of a pass."""
    return F.pmod(F.xxhash64(source, block, turn, F.lit(SEED)), F.lit(PLACES))


def source_plan(slim: DataFrame, max_repeat: float | None = 2.0, min_entropy: float | None = None, budget: float | None = None) -> list[tuple]:
    """(s, blocks, cells, passes, goal, total) of each source of (s, h, tokens): tokens to take, and whole or part passes."""
    sizes = slim.groupBy("s").agg(F.count("*").alias("rows"), F.sum("tokens").alias("tokens")).limit(MAX_SOURCES + 1).collect()
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes.sort(key=lambda r: r["s"])
    tokens = [float(r["tokens"]) for r in sizes]
    share = weights(tokens, bisect_exponent(tokens, max_repeat, min_entropy)) if any(tokens) else [0.0] * len(tokens)
    if budget is None:
        budget = max((t / w for t, w in zip(tokens, share) if w), default=0.0)
    passes = [max(1, math.ceil(round(w * budget / t, 9))) if t else 1 for w, t in zip(share, tokens)]
    cells = [max(1, min(4096, CELLS // len(sizes) // p)) for p in passes]
    return [(r["s"], -(-r["rows"] // BLOCK_ROWS), c, p, w * budget, t) for r, c, p, w, t in zip(sizes, cells, passes, share, tokens)]


def mix(docs: DataFrame, key: str = "doc_id", **target) -> DataFrame:
    """``docs``' columns plus pass (0, 1, ...) and mix_at (0 to 1, the place in the mixture): a row for each time a document is taken."""
    spark = docs.sparkSession
    source = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    own = F.xxhash64(F.col(key), F.col("text"), F.lit(SEED))
    slim = shared_table(docs.select(source.alias("s"), own.alias("h"), n_tokens("text").alias("tokens")), "mix-tokens")
    made = source_plan(slim, **target)
    plan = F.broadcast(spark.createDataFrame(made, "s string, blocks bigint, cells int, passes int, goal double, total double"))  # at most MAX_SOURCES rows
    block = F.pmod(F.col("h"), F.col("blocks"))
    planned = slim.join(plan, "s").withColumn("block", block)

    last = F.col("passes") - 1
    goals = [(s, 0, PLACES, goal - (passes - 1) * total) for s, _, _, passes, goal, total in made if total and goal - (passes - 1) * total < total * (1 - 1e-9)]
    cut = spark.createDataFrame([], "node string, cut bigint")
    if goals:
        places = planned.select(F.col("s").alias("node"), _order(F.col("s"), F.col("block"), last).alias("v"), F.col("tokens").alias("w"))
        cut = weighted_cuts(places, spark.createDataFrame(goals, "node string, lo bigint, hi bigint, need double"), PLACES, len(goals))
    turns = F.explode(F.sequence(F.lit(0), last)).alias("turn")
    cell = F.floor(F.col("at") / F.ceil(F.lit(PLACES) / F.col("cells"))).cast("int")
    laid = planned.select("s", "block", "tokens", "cells", turns).withColumn("at", _order(F.col("s"), F.col("block"), F.col("turn")))
    sums = laid.groupBy("s", "turn", cell.alias("cell")).agg(F.sum("tokens").alias("tokens"))
    before = Window.partitionBy("s", "turn").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    progress = shared_table(sums.select("s", "turn", "cell", "tokens", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base")), "mix-progress")

    wide = F.broadcast(plan.join(F.broadcast(cut.withColumnRenamed("node", "s")), "s", "left"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), source.alias("s"), own.alias("h")).join(wide, "s").withColumn("block", block)
    rows = rows.select("*", turns).withColumn("at", _order(F.col("s"), F.col("block"), F.col("turn")))
    rows = rows.where((F.col("turn") < last) | F.col("cut").isNull() | (F.col("at") < F.col("cut"))).withColumn("cell", cell)
    rows = rows.join(F.broadcast(progress), ["s", "turn", "cell"])
    width = F.ceil(F.lit(PLACES) / F.col("cells"))
    inside = (F.pmod(F.col("at"), width) * INSIDE + F.pmod(F.xxhash64("h"), F.lit(INSIDE))) / (width * INSIDE)
    at = F.least(F.lit(1.0), (F.col("turn") * F.col("total") + F.col("base") + F.col("tokens") * inside) / F.greatest("goal", F.lit(1.0)))
    names = [free_name(n, docs.columns) for n in ("pass", "mix_at")]
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], F.col("turn").alias(names[0]), F.when(F.col("total") > 0, at).otherwise(0.0).alias(names[1]))
