"""Weighted quantiles of many groups at once, with DataFrame functions only.

For each group a cut is sought that leaves a given weight below it.  Every round takes one histogram of at most ``BINS``
bins a group over the range that still holds the cut, and narrows that range to one bin; the histograms stay in tables, so
neither the driver nor the plan grows with the number of groups, and partial aggregation takes care of large groups.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop_shared, shared_table

BINS = 1 << 14
#: Rows of one file of a table that has a row a group.
_GROUPS = 100_000


def per_group(df: DataFrame, groups: int, name: str) -> DataFrame:
    """A written table of one row a group, in as few files as that number asks for."""
    return shared_table(df.repartition(1 + groups // _GROUPS), name)


def weighted_cuts(rows: DataFrame, goals: DataFrame, span: int, groups: int) -> DataFrame:
    """(node, cut) for each row of ``goals`` (node, lo, hi, need): rows (node, v, w) with v < cut weigh about ``need``.

    v, lo and hi are integers with lo <= v < hi and hi - lo <= ``span``; ``goals`` has at most ``groups`` rows.  The rows of the value that the goal falls into go
    to the side that needs them more; where all rows weigh less than the goal the cut is hi.
    """
    width = F.ceil((F.col("hi") - F.col("lo")) / F.lit(BINS)).cast("bigint")
    open_ = per_group(goals.select("node", F.col("lo").cast("bigint").alias("lo"), F.col("hi").cast("bigint").alias("hi"), F.col("need").cast("double").alias("need"), F.lit(0.0).alias("last")), groups, "cuts-goals")
    while span > 0:
        step = open_.withColumn("step", F.greatest(width, F.lit(1).cast("bigint")))
        held = rows.join(step, "node").where("v >= lo and v < hi")
        bins = held.groupBy("node", F.expr("(v - lo) div step").alias("bin")).agg(F.sum("w").cast("double").alias("w"))
        upto = bins.withColumn("upto", F.sum("w").over(Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
        hit = upto.join(step, "node").where("upto >= need").groupBy("node").agg(F.min(F.struct("bin", "w", "upto")).alias("h"))
        near = step.join(hit, "node", "left")
        lo = F.col("lo") + F.col("h.bin") * F.col("step")
        none = F.col("h").isNull()
        narrowed = near.select(
            "node", F.when(none, F.col("hi")).otherwise(lo).alias("lo"), F.when(none, F.col("hi")).otherwise(F.least(F.col("hi"), lo + F.col("step"))).alias("hi"),
            F.when(none, 0.0).otherwise(F.col("need") - (F.col("h.upto") - F.col("h.w"))).alias("need"), F.when(none, 0.0).otherwise(F.col("h.w")).alias("last"),
        )
        before, open_ = open_, per_group(narrowed, groups, "cuts-goals")
        drop_shared(before)
        span = -(-span // BINS) if span > 1 else 0
        if span == 1:
            break
    return open_.select("node", F.when(F.col("need") > F.col("last") / 2, F.col("hi")).otherwise(F.col("lo")).alias("cut"))
