"""Sharding by a k-d tree over metadata, with DataFrame functions only.

The root holds all rows.  A node is split in two along its widest dimension (the range of positions in the node) at the
weighted median of bytes: the cut gives the left side half of the node's leaves of ``target_bytes`` each.  A node that is
down to one leaf is a shard, so leaves hold the target bytes.  Strings stand at the rank of their whole value among the
table's values.  Rows with equal positions are ordered by a hash, so a value that fills a third of the table is split too.

Scale: the tree is never in the plan nor on the driver.  A slim table (no texts) carries each row's node; a level reads it a
fixed number of times, to find boxes and to narrow the cuts (``cuts.weighted_cuts``), joins it with one row a node, and
writes it anew.  There are log2(shards) levels.  Slots are numbered by per-bucket counts and a window within buckets, never
a window over a whole shard.

Defined results: a null or empty text has size 16 and the checksum of no bytes, 0, and very long ones count their bytes;
null metadata sorts first; ties are ordered by a hash; equal rows are interchangeable; an empty table gives no rows; with
fewer rows than shards some shards stay empty; a null doc_id stands at 0; columns other than the four that are read cannot
clash, as none is carried.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cuts import per_group, weighted_cuts
from .shared import drop_shared, shared_table

#: Positions along a dimension, and of the hash that orders equal values.
SPAN = 1 << 20
_ROWS_PER_BUCKET, _BOUNDS = 50_000, 512
DIMS = ["source", "lang", "length", "id"]


def string_ranks(values: DataFrame) -> DataFrame:
    """(dim, value, rank from 1, n) of the distinct non-null values of (dim, value), in order of the whole value.

    Values are dealt into ranges at a bounded sample of them and numbered within, so no task orders a whole dimension.
    """
    own = shared_table(values.where("value is not null").distinct(), "shard-values")
    n = {r["dim"]: r["n"] for r in own.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one row a dimension
    if not n:
        return own.select("dim", "value", F.lit(1).cast("bigint").alias("rank"), F.lit(1).cast("bigint").alias("n"))
    scale = 1 << 30
    share = F.create_map(*[F.lit(x) for d, c in n.items() for x in (d, int(min(1.0, _BOUNDS / c) * scale))])
    drawn = own.where(F.pmod(F.xxhash64("value"), F.lit(scale)) < F.element_at(share, F.col("dim"))).collect()  # about _BOUNDS a dimension
    bounds = {d: sorted((r["value"] for r in drawn if r["dim"] == d), key=lambda v: v.encode("utf-8", "surrogatepass")) for d in n}
    inside = lambda d: F.size(F.filter(F.array(*[F.lit(v) for v in bounds[d]]), lambda b: b < F.col("value"))) if bounds[d] else F.lit(0)
    bucket = F.coalesce(*[F.when(F.col("dim") == d, inside(d)) for d in n])
    dealt = own.withColumn("bucket", bucket)
    counts = dealt.groupBy("dim", "bucket").agg(F.count("*").alias("c"))
    before = Window.partitionBy("dim").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shared_table(counts.select("dim", "bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base")), "shard-offsets")
    number = F.row_number().over(Window.partitionBy("dim", "bucket").orderBy("value"))
    total = F.element_at(F.create_map(*[F.lit(x) for kv in n.items() for x in kv]), F.col("dim")).cast("bigint")
    ranked = dealt.withColumn("number", number).join(offsets, ["dim", "bucket"])
    return shared_table(ranked.select("dim", "value", (F.col("base") + F.col("number")).alias("rank"), total.alias("n")), "shard-ranks")


def positions(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, the four positions p0 to p3 (0 to SPAN - 1, in order of ``DIMS``) and tie: the slim table."""
    bytes_ = F.coalesce(F.octet_length("text"), F.lit(0))
    slim = docs.select(
        F.col(key).alias("doc_id"), (bytes_ + 16).cast("bigint").alias("size"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.col("source").cast("string").alias("s"), F.col("lang").cast("string").alias("l"), F.log2(bytes_ + 1.0).alias("length"), F.coalesce(F.col(key).cast("double"), F.lit(0.0)).alias("id"),
    )
    meta = shared_table(slim, "shard-metadata")
    both = F.explode(F.array(F.struct(F.lit(0).alias("dim"), F.col("s").alias("value")), F.struct(F.lit(1).alias("dim"), F.col("l").alias("value")))).alias("x")
    ranks = string_ranks(meta.groupBy("s", "l").agg(F.count("*")).select(both).select("x.*"))
    place = F.floor(F.col("rank") / F.col("n") * (SPAN - 1)).cast("int")
    for dim, c in ((0, "s"), (1, "l")):
        own = ranks.where(F.col("dim") == dim).select(F.col("value").alias(c), place.alias(f"p{dim}"))
        meta = meta.join(own, c, "left")
    ends = meta.agg(*[f(c).alias(f"{k}_{c}") for c in ("length", "id") for k, f in (("lo", F.min), ("hi", F.max))]).first()
    scaled = lambda c: F.floor((F.col(c) - (ends[f"lo_{c}"] or 0.0)) / max((ends[f"hi_{c}"] or 0.0) - (ends[f"lo_{c}"] or 0.0), 1e-300) * (SPAN - 1)).cast("int")
    tie = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(SPAN)).cast("int")
    some = lambda c: F.coalesce(c, F.lit(0))
    return meta.select("doc_id", "size", "text_crc32", some("p0").alias("p0"), some("p1").alias("p1"), scaled("length").alias("p2"), scaled("id").alias("p3"), tie.alias("tie"))


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, key: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot; ``docs`` has text, lang, source and the key.

    Leaves reach ``target_bytes``, or an equal share of all bytes for each of ``shards``.
    """
    if (shards is None) == (target_bytes is None):
        raise ValueError("give either shards or target_bytes")
    rows = shared_table(positions(docs, key).select("*", F.lit(0).alias("node")), "shard-rows")
    whole = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    if shards is None:
        shards = max(1, round(whole["bytes"] / target_bytes))
    rows = rows.withColumn("leaves", F.lit(shards))  # a node's first shard is its name; its leaves are the shards from there on
    for level in range((shards - 1).bit_length() if whole["rows"] else 0):
        rows = split_level(rows, 1 << level)
    placed = rows.select("doc_id", "size", "text_crc32", F.col("node").alias("shard"))
    return _slots(placed, whole["rows"], shards)


def split_level(rows: DataFrame, nodes: int) -> DataFrame:
    """Every node of several leaves, of at most ``nodes``, cut in two: the slim table with the children's node and leaves."""
    names = [f"p{i}" for i in range(len(DIMS))]
    ends = lambda f: F.array(*[f(n) for n in names])
    boxes = rows.where("leaves > 1").groupBy("node").agg(F.first("leaves").alias("leaves"), F.sum("size").alias("w"), ends(F.min).alias("low"), ends(F.max).alias("high"))
    width = F.transform(F.arrays_zip("low", "high"), lambda x, i: F.struct((x["high"] - x["low"]).alias("width"), (-i).alias("neg")))
    dim = -F.array_max(width)["neg"]  # ties go to the first dimension
    at = lambda c: F.get(F.col(c), F.col("dim")).cast("bigint") * SPAN
    need = F.col("w") * F.expr("leaves div 2") / F.col("leaves")
    goals = per_group(boxes.withColumn("dim", dim.cast("int")).select("node", "dim", at("low").alias("lo"), (at("high") + SPAN).alias("hi"), need.alias("need")), nodes, "shard-goals")
    v = F.get(F.array(*names), F.col("dim")).cast("bigint") * SPAN + F.col("tie")
    along = rows.select("node", "size", *names, "tie").join(goals.select("node", "dim"), "node").select("node", v.alias("v"), F.col("size").alias("w"))
    cuts = per_group(weighted_cuts(along, goals, SPAN * SPAN, nodes).join(goals.select("node", "dim"), "node"), nodes, "shard-cuts")
    right = F.coalesce(v >= F.col("cut"), F.lit(False))
    left = F.when(F.col("cut").isNull(), 0).otherwise(F.expr("cast(leaves div 2 as int)"))
    leaves = F.when(F.col("cut").isNull(), F.col("leaves")).when(right, F.col("leaves") - left).otherwise(left)
    keep = [c for c in rows.columns if c not in ("node", "leaves")]
    moved = shared_table(rows.join(cuts, "node", "left").select(*keep, F.when(right, F.col("node") + left).otherwise(F.col("node")).alias("node"), leaves.alias("leaves")), "shard-rows")
    drop_shared(rows)
    return moved


def _slots(placed: DataFrame, rows: int, shards: int) -> DataFrame:
    """Gapless numbers from 0 in each shard, in order of a hash: bucket offsets plus a window within buckets.

    Repeated rows differ in ``turn``, a number within the written table's splits, so that no bucket gets all of them.
    """
    buckets = max(1, -(-rows // (shards * _ROWS_PER_BUCKET)))
    per = placed.withColumn("turn", F.monotonically_increasing_id()).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "turn"), F.lit(buckets)).cast("int"))
    per = shared_table(per, "shard-slots") if buckets > 1 else per
    counts = per.groupBy("shard", "bucket").agg(F.count("*").alias("n"))  # shards x buckets rows
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "turn"))
    numbered = per.withColumn("inside", inside).join(offsets, ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("offset") + F.col("inside") - 1).cast("bigint").alias("slot"))
