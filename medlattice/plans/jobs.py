"""Jobs over whole tables (O2-O5, M11): prediction, evaluation, diagnostics, audit, threshold sweep."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.config import ASSERTABLE, FAMILY, HISTORICAL, LINKABLE, NEGATED, TYPES
from ..functions.settings import Settings
from ..functions.text import is_grounded
from ..operators.context import add_assertions
from ..operators.extract import beside, extract
from ..operators.link import link_concepts
from ..operators.score import ScorerConfig, nest, pair_up, plain, score_dataset
from ..operators.sections import cover_errors, placed_lines, segment
from ..operators.weak import clean_concepts
from ..sources.writers import records


def predict(docs: DataFrame, drug_kb: DataFrame | None = None, disease_kb: DataFrame | None = None, clean: bool = False, min_prob: float = 0.0, spans: DataFrame | None = None, settings: Settings = Settings(), assertion_model: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """O2: concepts of documents by rules, or from model spans (doc_id, text, type, start, end, conf) with rule assertions.

    Without knowledge bases nothing is linked.
    """
    if spans is None:
        out = extract(docs, settings)
    else:
        kept = spans.where(F.col("conf") >= min_prob).withColumn("ord", F.struct("start", "end", "type"))
        out = add_assertions(kept, docs, settings).select("doc_id", "ord", "text", "type", "start", "end", "assertions", F.array().cast("array<string>").alias("candidates"))
    if assertion_model:
        out = assertion_model(out)
    if clean:
        out = clean_concepts(out, docs)
    return link_concepts(out, drug_kb, disease_kb, settings) if drug_kb is not None else out


def predict_records(docs: DataFrame, **options) -> DataFrame:
    """Records per document; reading them raises if a concept of any document is not grounded."""
    annotated = beside(docs.select("doc_id", "raw"), predict(docs, **options))
    bad = F.exists("concepts", lambda c: ~is_grounded(F.col("raw"), c["text"], c["start"], c["end"]))
    return records(annotated.where(F.when(bad, F.raise_error(F.lit("a concept is not grounded"))).otherwise(F.lit(True))))


def evaluate(gold: DataFrame, pipeline: Callable[[DataFrame], DataFrame], cfg: ScorerConfig = ScorerConfig()) -> DataFrame:
    """Score a pipeline on labelled documents (doc_id, text, concepts).

    A pipeline returns concept rows, or the documents that it got, all their columns kept, with an array ``concepts``
    beside them; these are scored where they are.
    """
    docs = gold.select("doc_id", F.col("text").alias("raw"), F.col("concepts").alias("gold"))
    out = pipeline(docs)
    if {"gold", "concepts"} <= set(out.columns):
        return score_dataset(out.select("doc_id", plain("concepts").alias("pred"), "gold"), cfg)
    return score_dataset(pair_up(nest(out, "pred"), docs.select("doc_id", "gold")), cfg)


def diagnostics(docs: DataFrame, concepts: DataFrame) -> dict[str, DataFrame]:
    """O3: totals per document, histograms of types and assertions, link coverage, schema violations."""
    per = docs.select("doc_id").join(concepts.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").na.fill(0, ["n"])
    marks = concepts.select("doc_id", "type", F.explode("assertions").alias("assertion"))
    bad = (~F.col("type").isin(TYPES)) | (F.size(F.array_except("assertions", F.array(*[F.lit(a) for a in (NEGATED, FAMILY, HISTORICAL)]))) > 0) | (~F.col("type").isin(ASSERTABLE) & (F.size("assertions") > 0)) | (~F.col("type").isin(LINKABLE) & (F.size("candidates") > 0))
    return {
        "totals": per.agg(F.count("*").alias("docs"), F.sum("n").alias("concepts"), F.avg("n").alias("mean"), F.min("n").alias("min"), F.max("n").alias("max")),
        "types": concepts.groupBy("type").agg(F.count("*").alias("n")),
        "assertions": marks.groupBy("assertion").agg(F.count("*").alias("n")),
        "coverage": concepts.where(F.col("type").isin(LINKABLE)).groupBy("type").agg(F.count("*").alias("n"), F.count_if(F.size("candidates") > 0).alias("linked")),
        "violations": concepts.where(bad),
    }


def audit(docs: DataFrame) -> dict[str, DataFrame]:
    """Documents whose sections do not cover them, and bullets per section."""
    bullets = placed_lines(docs).where(F.col("line").rlike(r"(?U)^\s*[-*•]")).groupBy("section").agg(F.count("*").alias("n"))
    return {"cover_errors": cover_errors(docs, segment(docs)), "bullets": bullets}


def sweep(spans: DataFrame, thresholds: tuple[float, ...] = (0.0, 0.6, 0.75, 0.85), conf: str = "conf") -> DataFrame:
    """Spans kept and documents touched at each threshold, from one pass: each span goes to the thresholds it meets."""
    met = F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.col(conf) >= t)
    return spans.select("doc_id", F.explode(met).alias("threshold")).groupBy("threshold").agg(F.count("*").alias("spans"), F.countDistinct("doc_id").alias("docs"))
