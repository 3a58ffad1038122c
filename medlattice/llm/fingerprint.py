"""Document fingerprints by content-defined chunking.

A gear hash (each byte's random word, shifted left once per later byte, so that the last 32 bytes decide) marks
boundaries in the UTF-8 bytes.  Chunking is normalised: no cut within ``MIN`` bytes, a strict mask up to ``NORMAL``
bytes, a loose mask beyond, a forced cut at ``MAX``; so chunk lengths gather round ``NORMAL`` and an insertion moves
boundaries only near itself.  The fingerprint is the sorted set of (digest, length) of the distinct chunks; the
containment of A in B is the share, by length, of A's chunks that B has too.

Scale: fingerprints are a map.  What needs the next text in order of the key moves every text once, to ranges of (key, hash
of the text) whose bounds come from two levels of bounded samples, so a key that holds a third of the table is split too,
and the number of tasks grows with the bytes.  At most about ``MAX_RANGES`` bounds and first rows are broadcast, 64 MB; more
than MAX_RANGES x 1024 rows only make ranges longer, and a range is read as a stream.

Defined results: null or empty text has the empty fingerprint; an empty set is contained in an empty one with 1.0 and
in any other with 0.0.  Equal texts have equal fingerprints, repeated rows too; a single row is its own next.  Ties of the
key are ordered by a hash of the text, null keys come first.  Very long texts are hashed in bounded segments.  An empty table
gives no rows.  Columns that are not kept are not read, and where a kept one has the name of a result, the result's name
gets underscores (``free_name``).
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_name, map_rows, shared_table

#: Chunk lengths in bytes.
MIN, NORMAL, MAX = 16, 48, 256
#: Seven and five of the high bits, which have seen 24 bytes and more.
_STRICT, _LOOSE = np.uint32(0x3F800000), np.uint32(0x1F000000)
#: Ranges at most, so that their bounds can be broadcast; rows of a text range; bytes of a task.
MAX_RANGES, RANGE_ROWS, TASK_BYTES = 1 << 20, 1024, 1 << 26
_GEAR = np.frombuffer(hashlib.shake_256(b"gear").digest(256 * 4), np.uint32)
_SEGMENT = 1 << 20


def _gear_marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions after which the loose mask allows a cut, and whether the strict mask allows it too; in bounded segments."""
    at, strict = [], []
    for lo in range(0, len(data), _SEGMENT):
        begin = max(0, lo - 31)
        h = _GEAR[data[begin : lo + _SEGMENT]]
        for step in (1, 2, 4, 8, 16):  # sums of 2, 4, ... 32 shifted words
            longer = h.copy()
            longer[step:] += h[:-step] << np.uint32(step)
            h = longer
        h = h[lo - begin :]
        loose = np.flatnonzero((h & _LOOSE) == 0)
        at.append(loose + lo + 1)
        strict.append((h[loose] & _STRICT) == 0)
    return (np.concatenate(at), np.concatenate(strict)) if at else (np.empty(0, int), np.empty(0, bool))


def cuts(data: bytes) -> list[int]:
    """End offsets of the chunks of ``data``; the last is its length."""
    size = len(data)
    if size <= MIN:
        return [size] if size else []
    marks, strict = _gear_marks(np.frombuffer(data, np.uint8))
    out, start = [], 0
    for end, hard in zip(marks.tolist(), strict.tolist()):
        while end - start > MAX:
            start += MAX
            out.append(start)
        n = end - start
        if n >= MIN and (hard or n >= NORMAL):
            out.append(end)
            start = end
    while size - start > MAX:
        start += MAX
        out.append(start)
    if start < size:
        out.append(size)
    return out


def chunk_set(text: str | None) -> dict[int, int]:
    """48-bit digest -> length in bytes, of the distinct chunks."""
    data = (text or "").encode("utf-8", "surrogatepass")
    found, start = {}, 0
    for end in cuts(data):
        found[xxhash.xxh3_64_intdigest(data[start:end]) >> 16] = end - start
        start = end
    return found


def serialise(chunks: dict[int, int]) -> str:
    """Sixteen hex digits a chunk, in order of digest: twelve of the digest, four of the length."""
    words = np.fromiter((d << 16 | n for d, n in chunks.items()), np.uint64, len(chunks))
    words.sort()
    return words.astype(">u8").tobytes().hex()


def parse(fingerprint: str) -> dict[int, int]:
    words = np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(np.uint64)
    return dict(zip((words >> np.uint64(16)).tolist(), (words & np.uint64(0xFFFF)).tolist()))


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Share by length of the chunks of ``a`` that are in ``b``."""
    total = sum(a.values())
    if not total:
        return 0.0 if b else 1.0
    return sum(a[d] for d in a.keys() & b.keys()) / total


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` plus fingerprint and n_chunks, one row per row; a plain map."""
    types, names = dict(docs.dtypes), [free_name(n, keep) for n in ("fingerprint", "n_chunks")]

    def run(cols):
        sets = [chunk_set(t) for t in cols[text]]
        return {c: cols[c] for c in keep} | {names[0]: [serialise(s) for s in sets], names[1]: [len(s) for s in sets]}

    schema = ", ".join([*[f"`{c}` {types[c]}" for c in keep], f"`{names[0]}` string, `{names[1]}` int"])
    return map_rows(docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])]), run, schema)


def _located(p: Column, groups: Column, width: int) -> Column:
    """How many of the bounds lie below ``p``; they are in order, in groups of ``width``, and none are empty."""
    group = F.size(F.filter(F.transform(groups, lambda g: F.get(g, 0)), lambda b: b < p))
    inside = F.size(F.filter(F.get(groups, group - 1), lambda b: b < p))
    return F.when(group == 0, 0).otherwise((group - 1) * width + inside)


def _grouped(bounds: Column, width: int) -> Column:
    """An ordered array as groups of ``width``."""
    n = F.ceil(F.size(bounds) / width).cast("int")
    every = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.slice(bounds, i * width + 1, F.lit(width)))
    return F.filter(every, lambda g: F.size(g) > 0)


def with_next(docs: DataFrame, key: str, text: str, rows_per_bucket: int = RANGE_ROWS) -> DataFrame:
    """Rows (k, t) dealt into ranges ``b`` and sorted within them, each range ending with a copy (``spare``) of the next one's first rows.

    The ranges are fixed before the shuffle, so a retried task sees the same ones.  The last range ends with the table's
    first row.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(key).cast("bigint").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    place = F.struct(F.coalesce("k", F.lit(-(1 << 63))).alias("k"), F.xxhash64("t").alias("h")).alias("p")
    slim = shared_table(plain.select(place, F.octet_length("t").alias("bytes")), "next-places")
    whole = slim.agg(F.count("*").alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    n = min(MAX_RANGES, max(1, -(-whole["rows"] // rows_per_bucket)))
    outer = int(n**0.5) + 1
    inner, scale = -(-n // outer), 1 << 30
    wide, deep = int(outer**0.5) + 1, int(inner**0.5) + 1
    drawn = lambda seed, k: F.pmod(F.xxhash64("p.k", "p.h", F.lit(seed)), F.lit(scale)) < int(min(1.0, k / max(1, whole["rows"])) * scale)
    # every 16th of a sample of 16 rows a range: first of the whole table, on the driver, then of each outer range
    found = sorted({(r["p"]["k"], r["p"]["h"]) for r in slim.where(drawn(1, 16 * outer)).select("p").collect()})[::16]
    kind = "array<array<struct<k:bigint,h:bigint>>>"
    first = F.broadcast(spark.createDataFrame([(0, [found[i : i + wide] for i in range(0, len(found), wide)])], f"one int, bounds {kind}"))  # a single row
    outer_range = lambda rows: rows.withColumn("one", F.lit(0)).join(first, "one").withColumn("b1", _located(F.col("p"), F.col("bounds"), wide)).drop("bounds", "one")

    held = outer_range(slim.where(drawn(2, 16 * n)).select("p")).groupBy("b1").agg(F.array_sort(F.collect_set("p")).alias("x"))
    second = shared_table(held.select("b1", _grouped(F.filter("x", lambda p, i: i % 16 == 0), deep).alias("bounds")), "next-bounds")

    def ranged(rows: DataFrame) -> DataFrame:
        inside = outer_range(rows).join(F.broadcast(second), "b1", "left")  # at most about MAX_RANGES bounds
        b2 = F.when(F.col("bounds").isNull(), 0).otherwise(_located(F.col("p"), F.col("bounds"), deep))
        return inside.withColumn("b", F.col("b1").cast("bigint") * (1 << 32) + b2).drop("bounds")

    firsts = shared_table(ranged(slim.select("p")).groupBy("b1", "b").agg(F.min("p").alias("first")), "next-firsts")
    last = {r["b1"]: r["b"] for r in firsts.groupBy("b1").agg(F.max("b").alias("b")).collect()}  # at most ``outer`` rows
    if not last:
        return plain.select(F.lit(0).cast("bigint").alias("b"), F.lit(0).alias("spare"), "k", "t").limit(0)
    order = sorted(last)
    before = F.create_map(*[F.lit(x) for i, b1 in enumerate(order) for x in (b1, last[order[i - 1]])])  # before the first range comes the last
    prior = F.coalesce(F.lag("b").over(Window.partitionBy("b1").orderBy("b")), F.element_at(before, F.col("b1")))
    ends = shared_table(firsts.select("b", "first", prior.alias("prior")), "next-ends")

    placed = ranged(plain.withColumn("p", place)).join(F.broadcast(ends), "b")  # at most about MAX_RANGES rows
    here = F.struct(F.col("b").alias("b"), F.lit(0).alias("spare"))
    there = F.struct(F.col("prior").alias("b"), F.lit(1).alias("spare"))
    dealt = placed.select("k", "t", "p", F.explode(F.when(F.col("p") == F.col("first"), F.array(here, there)).otherwise(F.array(here))).alias("x")).select("x.b", "x.spare", "k", "t", "p")
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-whole["bytes"] // TASK_BYTES))
    return dealt.repartition(tasks, "b").sortWithinPartitions("b", "spare", "p").select("b", "spare", "k", "t")


def edited_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, and its likeness to that and to the next text.

    The edited form replaces the last half of the code points by as many of the next text, in order of key (ties: of a hash of the text).
    """
    schema = pa.schema([(key, pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []

        def row(one, other):
            (k, t, own), (t2, next_set) = one[1:4], other[2:4]
            half = len(t) // 2
            edited = t[: len(t) - half] + t2[:half]
            changed = chunk_set(edited)
            return (k, len(t), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), serialise(own), serialise(changed), containment(own, changed), containment(own, next_set))

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            rows.clear()
            return batch

        for batch in it:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for b, spare, k, t in zip(*(part.column(i).to_pylist() for i in range(4))):
                    if spare and (held is None or held[0] != b or held[4]):
                        continue  # only the first spare row of a range is its last row's next
                    one = (b, k, t, chunk_set(t), bool(spare))
                    if held is not None and not held[4] and held[0] == b:
                        rows.append(row(held, one))
                    held = one
                if len(rows) >= 512:
                    yield flush()
        if rows:
            yield flush()

    ddl = f"`{key}` bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, key, text).mapInArrow(run, ddl)

