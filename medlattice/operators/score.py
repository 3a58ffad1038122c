"""Scoring predictions against gold (M5-M10): greedy alignment inside a document's row in Arrow batches, then one aggregation."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import arrow_column
from ..functions.config import ASSERTABLE, LINKABLE
from ..functions.text import text_key

CONCEPTS = "array<struct<text:string,type:string,start:int,end:int,assertions:array<string>,candidates:array<string>>>"
#: Shares of text, assertions and candidates in the final score.
WEIGHTS = (0.3, 0.3, 0.4)


@dataclass(frozen=True)
class ScorerConfig:
    wer_mode: str = "aligned"  # or "concat"
    cap_wer: bool = True
    align_mode: str = "overlap"  # or "exact_text"
    wer_lowercase: bool = False
    penalize_orphans: bool = True

    def __post_init__(self):
        if self.wer_mode not in ("aligned", "concat") or self.align_mode not in ("overlap", "exact_text"):
            raise ValueError(f"unknown mode in {self}")


def align(pred: list[tuple], gold: list[tuple], mode: str = "overlap") -> list[int]:
    """M5: the place of each gold concept's partner among the predictions (-1 for none); concepts are (type, start, end, key).

    Gold concepts in order each take the best unused prediction of their type: most overlap, or equal text and nearest
    start; the first of equals wins.
    """
    own: dict[str, list] = {}
    for j, (k, s, e, x) in enumerate(pred):
        own.setdefault(k, []).append((j, s, e, x))
    out = []
    for kind, start, end, key in gold:
        free, best, at = own.get(kind) if kind is not None else None, None, None
        for n, (_, s, e, x) in enumerate(free or ()):
            if mode == "overlap":
                if None in (start, end, s, e):  # of two ends or starts the one that is there counts
                    ends, starts = [v for v in (end, e) if v is not None], [v for v in (start, s) if v is not None]
                    value = min(ends) - max(starts) if ends and starts else 0
                else:
                    value = (end if end < e else e) - (start if start > s else s)
                fits = value > 0
            else:
                fits = key is not None and x == key and start is not None and s is not None
                value = -abs(s - start) if fits else 0
            if fits and (best is None or value > best):
                best, at = value, n
        out.append(-1 if at is None else free.pop(at)[0])
    return out


def _wer(ref: str | None, hyp: str | None, lower: bool) -> float | None:
    """M2 of two texts."""
    if ref is None or hyp is None:
        return None
    r, h = (t.lower().split() if lower else t.split() for t in (ref, hyp))
    if not r or r == h:
        return 0.0 if r == h else 1.0
    row = list(range(len(h) + 1))
    for i, x in enumerate(r, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(h, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1] / len(r)


def _average(values: list, empty: float) -> float | None:
    total = 0.0
    for v in values:
        if v is None:
            return None
        total += v
    return total / len(values) if values else empty


def _jaccard(gold: list | None, pred: list | None) -> float | None:
    if gold is None or pred is None:
        return None
    g, p = set(gold), set(pred)
    return len(g & p) / len(g | p) if g or p else 1.0


def _one(pred: list[tuple], gold: list[tuple], cfg: ScorerConfig) -> tuple:
    """(wer, assertions, candidates, weight) of a document; concepts are (type, start, end, key, text, assertions, candidates)."""
    links = align([p[:4] for p in pred], [g[:4] for g in gold], cfg.align_mode)
    taken = set(links)
    matched = [(g, pred[j]) for g, j in zip(gold, links) if j >= 0]
    missed, extra = [g for g, j in zip(gold, links) if j < 0], [p for j, p in enumerate(pred) if j not in taken]
    if cfg.wer_mode == "concat":
        last = lambda v: (v is not None, v or 0)  # noqa: E731  nulls come first
        text = lambda cs: " ".join(c[4] for c in sorted(cs, key=lambda c: (last(c[1]), last(c[2]))) if c[4] is not None)
        error = _wer(text(gold), text(pred), cfg.wer_lowercase)
    else:
        errors = [_wer(g[4], p[4], cfg.wer_lowercase) for g, p in matched]
        errors = [1.0 if e is None else min(1.0, e) for e in errors] if cfg.cap_wer else errors
        error = _average(errors + [1.0] * (len(missed) + len(extra)), 0.0)
    scores = []
    for types, field in ((ASSERTABLE, 5), (LINKABLE, 6)):
        own = [(g, p) for g, p in matched if g[0] in types]
        lost, added = [g for g in missed if g[0] in types], sum(p[0] in types for p in extra)
        values, counted = [_jaccard(g[field], p[field]) for g, p in own], [g for g, _ in own]
        if cfg.penalize_orphans:
            values, counted = values + [0.0] * (len(lost) + added), counted + lost
        scores.append(_average(values, 1.0))
        codes = [g[6] for g in counted]
        weight = None if any(c is None for c in codes) else float(sum(len(set(c)) + 1 for c in codes) + (added if cfg.penalize_orphans else 0))
    return error, *scores, weight


def _documents(concepts: pa.Array, keys: pa.Array) -> list[list[tuple]]:
    """Concepts of each document as tuples, field by field, which is much cheaper than row by row."""
    item = concepts.flatten()
    fields = [item.field(n).to_pylist() for n in ("type", "start", "end")] + [keys.flatten().to_pylist()] + [item.field(n).to_pylist() for n in ("text", "assertions", "candidates")]
    rows, ends = list(zip(*fields)), np.cumsum(pc.fill_null(pc.list_value_length(concepts), 0).to_numpy()).tolist()
    return [rows[a:b] for a, b in zip([0, *ends], ends)]


def score_samples(pairs: DataFrame, cfg: ScorerConfig = ScorerConfig()) -> DataFrame:
    """M6-M8 per document of (doc_id, pred, gold): text, assertions, candidates, weight, wer; missing sides count as empty."""
    none = F.array().cast(CONCEPTS)
    rows = pairs.select("doc_id", F.coalesce(F.col("pred").cast(CONCEPTS), none).alias("pred"), F.coalesce(F.col("gold").cast(CONCEPTS), none).alias("gold"))
    key = lambda c: F.transform(c, lambda x: text_key(x["text"]) if cfg.align_mode == "exact_text" else F.lit(None).cast("string"))

    def run(pred: pa.Array, pred_keys: pa.Array, gold: pa.Array, gold_keys: pa.Array, kind: pa.DataType) -> pa.Array:
        scores = [_one(p, g, cfg) for p, g in zip(_documents(pred, pred_keys), _documents(gold, gold_keys))]
        return pa.StructArray.from_arrays([pa.array([s[i] for s in scores], f.type) for i, f in enumerate(kind)], fields=list(kind))

    scored = rows.select("doc_id", arrow_column(run, "struct<wer:double,assertions:double,candidates:double,weight:double>", "pred", key("pred"), "gold", key("gold")).alias("s"))
    return scored.select("doc_id", "s.*").withColumn("text", 1.0 - F.col("wer"))


def score_dataset(pairs: DataFrame, cfg: ScorerConfig = ScorerConfig()) -> DataFrame:
    """M9: one row: final, text_score, assertions_score, candidates_score, n; candidates are weighted; no documents give 0."""
    s = score_samples(pairs, cfg).agg(
        F.count("*").alias("n"), F.avg("text").alias("t"), F.avg("assertions").alias("a"), F.sum("weight").alias("w"), F.sum(F.col("candidates") * F.col("weight")).alias("cw")
    )
    candidates = F.when(F.col("n") == 0, 0.0).when(F.col("w") > 0, F.col("cw") / F.nullif(F.col("w"), F.lit(0.0))).otherwise(1.0)
    out = s.select(F.coalesce("t", F.lit(0.0)).alias("text_score"), F.coalesce("a", F.lit(0.0)).alias("assertions_score"), candidates.alias("candidates_score"), "n")
    return out.select((WEIGHTS[0] * F.col("text_score") + WEIGHTS[1] * F.col("assertions_score") + WEIGHTS[2] * F.col("candidates_score")).alias("final"), "*")


def plain(concepts: Column | str) -> Column:
    """Concepts of an array in the scorer's form, without their places in the document's order."""
    return F.transform(concepts, lambda c: F.struct(c["text"].alias("text"), c["type"].alias("type"), c["start"].cast("int").alias("start"), c["end"].cast("int").alias("end"), c["assertions"].alias("assertions"), c["candidates"].alias("candidates")))


def nest(concepts: DataFrame, name: str) -> DataFrame:
    """Concept rows to one array a document, in order of ``ord``."""
    c = F.struct("text", "type", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "assertions", "candidates")
    return concepts.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", c.alias("c")))), lambda x: x["c"]).alias(name))


def pair_up(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """(doc_id, pred, gold) from nested tables; a document that only one side has is kept."""
    return pred.join(gold, "doc_id", "full_outer")


def score_json(rows: DataFrame, cfg: ScorerConfig = ScorerConfig()) -> DataFrame:
    """Pred and gold as JSON arrays of records with ``position``."""
    schema = "array<struct<text:string,type:string,position:array<int>,assertions:array<string>,candidates:array<string>>>"
    empty = F.array().cast("array<string>")

    def concepts(c: str) -> Column:
        made = lambda x: F.struct(F.coalesce(x["text"], F.lit("")).alias("text"), F.coalesce(x["type"], F.lit("")).alias("type"), F.coalesce(F.get(x["position"], 0), F.lit(0)).alias("start"), F.coalesce(F.get(x["position"], 1), F.lit(0)).alias("end"), F.coalesce(x["assertions"], empty).alias("assertions"), F.coalesce(x["candidates"], empty).alias("candidates"))
        return F.transform(F.from_json(c, schema), made)

    return score_dataset(rows.select("doc_id", concepts("pred").alias("pred"), concepts("gold").alias("gold")), cfg)
