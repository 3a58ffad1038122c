"""Line tables and sections.

Headers and sections come from one pass over each document (``reader.py``), so they need no shuffle; the plain line tables
are expressions.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import arrow_column
from ..functions.settings import Settings
from ..functions.text import LINE_BREAK, grown, items, no_items
from .reader import LINES, SPANS, lines_of, reader, spans_of


def line_table(docs: DataFrame, pattern: str = LINE_BREAK, whole: bool = False) -> DataFrame:
    """doc_id, line_no, line_start, line (without its break); empty trailing piece dropped.

    ``whole`` adds size, the document's length, and keeps the one empty line of an empty document.
    """
    pieces = F.split("raw", pattern, -1)
    breaks = F.regexp_extract_all("raw", F.lit(pattern), F.lit(0))
    more = [F.length("raw").alias("size")] if whole else []
    both = docs.select("doc_id", *more, F.posexplode(F.arrays_zip(pieces.alias("line"), breaks.alias("brk"))).alias("line_no", "x"))
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("x.line") + F.coalesce(F.length("x.brk"), F.lit(0))
    rows = both.select("doc_id", "line_no", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("int").alias("line_start"), F.col("x.line").alias("line"), F.col("x.brk").isNull().alias("last"), *["size"] * whole)
    return rows.where("not (last and line = '')" + " or line_no = 0" * whole).drop("last")


def newline_spans(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, start, end of lines that end at line feeds only, the feed included."""
    nxt = F.lead("line_start").over(Window.partitionBy("doc_id").orderBy("line_no"))
    lines = line_table(docs, "\n", whole=True)
    return lines.select("doc_id", "line_no", F.col("line_start").alias("start"), F.coalesce(nxt, F.col("size")).cast("int").alias("end"), "size").where("size > 0").drop("size")


def packed(lines: Column, fits) -> Column:
    """Lines (start, end, n) in order joined to runs while ``fits(run, line)``; a line that fits into none is a run of its own."""
    kind = "struct<start:int,end:int,n:int>"
    begin = F.struct(F.lit(None).cast(kind).alias("run"), no_items(kind).alias("out"))
    line = lambda x: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"), x["n"].cast("int").alias("n"))

    def step(acc, x):
        run = acc["run"]
        joins = run.isNotNull() & fits(run, x)
        longer = F.struct(run["start"].alias("start"), x["end"].cast("int").alias("end"), (run["n"] + x["n"]).cast("int").alias("n"))
        return F.struct(F.when(joins, longer).otherwise(line(x)).alias("run"), F.when(joins | run.isNull(), acc["out"]).otherwise(grown(acc["out"], run)).alias("out"))

    return F.aggregate(lines, begin, step, lambda acc: F.concat(items(acc["out"]), F.array_compact(F.array(acc["run"]))))


# --- G1: canonical section of a header text


def match_canonical(texts: DataFrame, header: str = "header", settings: Settings = Settings(), fuzzy: bool = True) -> DataFrame:
    """G1 for a table of header texts: adds canonical and confidence (null and 0.0 without a match).

    Tiers: equal; the longest pattern inside that covers enough; the most similar pattern above the threshold; any
    pattern inside.  Ties go to the first pattern in order.
    """
    def match(texts: pa.Array, kind: pa.DataType) -> pa.Array:
        r = reader(settings, fuzzy)
        known = {t: r.canonical(t) for t in texts.unique().to_pylist()}
        found = [known[t] for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([f[i] for f in found], t.type) for i, t in enumerate(kind)], fields=list(kind))

    rows = texts.withColumn("_m", arrow_column(match, "struct<canonical:string,confidence:double>", header))
    return rows.select(*texts.columns, "_m.canonical", "_m.confidence")


# --- G2, G3


def placed_lines(docs: DataFrame, settings: Settings = Settings(), fuzzy: bool = True) -> DataFrame:
    """G2, and the open section along the lines: doc_id, line_no, line_start, line, kind (num, colon, bare or null), header, canonical, section, section_header, doc_section."""
    lines = arrow_column(lambda raw, kind: lines_of(raw, settings, fuzzy, kind), LINES, "raw")
    return docs.select("doc_id", F.explode(lines).alias("x")).select("doc_id", "x.*")


def spans(raw: Column | str, settings: Settings = Settings(), fuzzy: bool = True) -> Column:
    """G3 as an array beside the text: its sections in order."""
    return arrow_column(lambda texts, kind: spans_of(texts, settings, fuzzy, kind), SPANS, raw)


def segment(docs: DataFrame, settings: Settings = Settings(), fuzzy: bool = True) -> DataFrame:
    """doc_id, canonical, char_start, char_end, header_text, doc_section; contiguous, covering each document."""
    return docs.select("doc_id", F.explode(spans("raw", settings, fuzzy)).alias("x")).select("doc_id", "x.*")


def span_at(spans: Column, pos: Column) -> Column:
    """The last section that begins at or before a position, or null."""
    return F.try_element_at(F.filter(spans, lambda s: s["char_start"] <= pos), F.lit(-1))


def section_at(points: DataFrame, spans: DataFrame, pos: str = "pos") -> DataFrame:
    """The span that holds each position, as-of by carry-forward over the union of both tables."""
    a = points.select("doc_id", F.col(pos).alias("_p"), F.lit(1).alias("_o"), F.struct(*points.columns).alias("_row"), F.lit(None).cast(_span_type(spans)).alias("_span"))
    b = spans.select("doc_id", F.col("char_start").alias("_p"), F.lit(0).alias("_o"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.struct("canonical", "header_text", "doc_section").alias("_span"))
    w = Window.partitionBy("doc_id").orderBy("_p", "_o").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("_span", F.last("_span", ignorenulls=True).over(w)).where("_row is not null").select("_row.*", "_span.*")


def _span_type(spans: DataFrame) -> str:
    return "struct<canonical:string,header_text:string,doc_section:string>"


def covers(raw: Column, spans: Column) -> Column:
    """Whether a text's sections begin at 0, end at its end and touch; none or null do not."""
    begin = F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok"))
    walk = F.aggregate(spans, begin, lambda acc, s: F.struct(s["char_end"].cast("int").alias("at"), (acc["ok"] & (s["char_start"] == acc["at"])).alias("ok")))
    return F.coalesce((F.size(spans) > 0) & walk["ok"] & (walk["at"] == F.length(raw)), F.lit(False))


def cover_errors(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_ids whose spans do not begin at 0, end at the text's end or touch."""
    per = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("char_start", "char_end"))).alias("_s"))
    return docs.select("doc_id", "raw").join(per, "doc_id", "left").where(~covers(F.col("raw"), F.col("_s"))).select("doc_id")
