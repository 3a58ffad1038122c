"""Weak supervision and de-noising.

Order-dependent rules are folds over one document's sorted array; everything that counts or joins is relational.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import arrow_column
from ..functions.config import ABBREVIATIONS, ASSERTABLE, DIAGNOSIS, DRUG, FILLERS, LAB_NAME, LINKABLE, SYMPTOM
from ..functions.settings import Settings
from ..functions.text import TOKEN_LEFT, TOKEN_RIGHT, WS, bind, collapse, find_all, first_match, is_grounded, mark, multi_hot, n_words, normalize, normalize_literal, parse_marked, strip, strip_span, trimmed, words
from .extract import beside, flat
from .reader import RUNS, TIDIED, WINDOWS, runs_of, tidied, windows_of
from .sections import newline_spans, packed


# --- W1, W2: dictionary labelling


def term_index(diseases: DataFrame, drugs: DataFrame, symptoms: DataFrame, labs: DataFrame, max_words: int = 8) -> DataFrame:
    """Norm, type, code; the first source and row that has a key wins; abbreviations inherit from their full form."""
    def source(i: int, df: DataFrame, kind: str, coded: bool) -> DataFrame:
        at = F.struct(F.lit(i).alias("source"), F.col("prio" if "prio" in df.columns else "ord").cast("bigint").alias("prio"), F.col("ord").cast("bigint").alias("ord"))
        return df.select(at.alias("at"), collapse(F.col("term")).alias("norm"), F.lit(kind).alias("type"), (F.col("code") if coded else F.lit(None).cast("string")).alias("code"))

    plain = drugs.where(~F.col("term").rlike(r"(?U)\d") & (n_words(F.col("term")) <= 3))
    every = source(0, _by_code(diseases), DIAGNOSIS, True).unionByName(source(1, _by_code(plain), DRUG, True)).unionByName(source(2, symptoms, SYMPTOM, False)).unionByName(source(3, labs, LAB_NAME, False))
    kept = every.where((F.length("norm") >= 3) & (F.size(words(F.col("norm"))) <= max_words))
    index = kept.groupBy("norm").agg(F.min_by(F.struct("type", "code"), "at").alias("x")).select("norm", "x.type", "x.code").persist()  # as large as the dictionaries; read several times
    short = index.sparkSession.createDataFrame([(normalize_literal(a), normalize_literal(full)) for a, full in ABBREVIATIONS.items()], "ab string, norm string")
    inherited = short.join(index, "norm").select(F.col("ab").alias("norm"), "type", "code").join(index.select("norm"), "norm", "left_anti")
    return index.unionByName(inherited)


def _by_code(kb: DataFrame) -> DataFrame:
    """Terms in order of their code's first appearance, then their own."""
    if "prio" not in kb.columns:
        kb = kb.withColumn("prio", F.lit(0))
    w = Window.partitionBy("code")
    head = F.min(F.struct(F.col("prio"), F.col("ord"))).over(w)
    return kb.withColumn("_h", head).select(F.col("_h.ord").alias("prio"), "ord", "code", "term")


def _bits(texts: DataFrame, size: int) -> bytes:
    """A set of texts as a bitmap of their checksums: of bounded size whatever there is, and never without a text that is in it."""
    at = F.col("_x") % size
    words = texts.select(F.crc32(F.col("_x").cast("binary")).alias("_x")).select((at / 32).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (at % 32).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    out = bytearray(size // 8)
    for w, b in words.collect():
        out[4 * w : 4 * w + 4] = b.to_bytes(4, "little")
    return bytes(out)


def distant_label(docs: DataFrame, index: DataFrame, max_words: int = 8) -> DataFrame:
    """Leftmost-longest, non-overlapping dictionary spans of texts (doc_id, raw).

    Runs of up to ``max_words`` tokens are looked up beside their text in a bitmap of the dictionary, which loses none; only
    those that pass meet the dictionary itself in an equi-join.  The few hits of a document are then folded in order, and its
    text is joined once to cut them out.
    """
    heads = _bits(index.select(F.split("norm", " ")[0].alias("_x")), 1 << 20)
    terms = _bits(index.select(F.col("norm").alias("_x")), 1 << 22)
    runs = arrow_column(lambda raw, kind: runs_of(raw, heads, terms, max_words, kind), RUNS, "raw")
    found = docs.select("doc_id", F.explode(runs).alias("x")).select("doc_id", "x.*").join(index, "norm")
    per = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", F.col("s"), (-F.col("e")).alias("neg"), "type", "code"))).alias("hits"))
    rows = docs.select("doc_id", "raw").join(per, "doc_id")

    def cut(x):
        text, start = trimmed(F.substring(F.col("raw"), x["s"] + 1, -x["neg"] - x["s"]), x["s"], TOKEN_LEFT, TOKEN_RIGHT)
        return F.struct(x["i"].alias("i"), x["s"].alias("tok_start"), start.alias("start"), text.alias("text"), x["type"].alias("type"), x["code"].alias("code"))

    rows = rows.select("doc_id", F.transform("hits", cut).alias("hits"))
    kind = rows.schema["hits"].dataType.elementType
    begin = F.struct(F.lit(-1).alias("i"), F.lit(0).alias("end"), F.array().cast(f"array<{kind.simpleString()}>").alias("out"))

    def step(acc, h):  # of the runs from one token the longest comes first and alone counts
        take = (h["i"] != acc["i"]) & (h["tok_start"] >= acc["end"])
        return F.struct(h["i"].alias("i"), F.when(take, h["start"] + F.length(h["text"])).otherwise(acc["end"]).alias("end"), F.when(take, F.concat(acc["out"], F.array(h))).otherwise(acc["out"]).alias("out"))

    kept = rows.select("doc_id", F.posexplode(F.aggregate("hits", begin, step, lambda acc: acc["out"])).alias("ord", "c"))
    codes = F.when(F.col("c.code").isNotNull(), F.array("c.code")).otherwise(F.array().cast("array<string>"))
    return kept.select("doc_id", "ord", "c.text", "c.type", "c.start", (F.col("c.start") + F.length("c.text")).alias("end"), F.array().cast("array<string>").alias("assertions"), codes.alias("candidates"))


# --- W3-W6: grounding and voting over samples


def ground(samples: DataFrame) -> DataFrame:
    """Marked samples (doc_id, sample, raw, marked) to grounded concepts: a forward cursor, else the first place, else dropped."""
    parsed = samples.withColumn("c", parse_marked(F.col("marked"))["concepts"])
    places = F.transform("c", lambda c: F.struct(c["type"].alias("type"), c["assertions"].alias("assertions"), find_all(F.col("raw"), c["text"]).alias("at")))
    out = "array<struct<text:string,type:string,start:int,end:int,assertions:array<string>>>"
    begin = F.struct(F.lit(0).alias("cursor"), F.array().cast(out).alias("out"))

    def step(acc, c):
        m = F.coalesce(first_match(c["at"], acc["cursor"]), first_match(c["at"]))
        made = F.struct(m["raw"].alias("text"), c["type"], m["start"].alias("start"), m["end"].alias("end"), c["assertions"])
        return F.struct(F.coalesce(m["end"], acc["cursor"]).alias("cursor"), F.when(m.isNotNull(), F.concat(acc["out"], F.array(made))).otherwise(acc["out"]).alias("out"))

    rows = parsed.select("doc_id", "sample", F.posexplode(F.aggregate(places, begin, step, lambda acc: acc["out"])).alias("ord", "c"))
    return rows.select("doc_id", "sample", "ord", "c.*")


def vote_counts(grounded: DataFrame, min_votes: int = 2) -> DataFrame:
    """Spans (doc_id, type, start, end) in at least ``min_votes`` samples, with the majority's assertions (ties: first seen)."""
    first = grounded.withColumn("a", F.array_sort("assertions")).groupBy("doc_id", "type", "start", "end", "sample").agg(F.min_by(F.struct("text", "a", "ord"), "ord").alias("x"))
    seen = first.groupBy("doc_id", "type", "start", "end", F.col("x.a").alias("a")).agg(F.count("*").alias("n"), F.min(F.struct("sample", "x.ord")).alias("at"), F.max_by("x.text", "sample").alias("text"))
    per = seen.groupBy("doc_id", "type", "start", "end").agg(F.sum("n").alias("votes"), F.min_by("a", F.struct((-F.col("n")).alias("neg"), "at")).alias("assertions"), F.min("at").alias("at"), F.max("text").alias("text"))
    return per.where(F.col("votes") >= min_votes)


def resolve_overlaps(voted: DataFrame) -> DataFrame:
    """Per document keep spans by votes, then length, then start, then first seen, if they overlap none kept."""
    key = F.struct((-F.col("votes")).alias("v"), (F.col("start") - F.col("end")).alias("l"), "start", "at", "end", "type", "text", "assertions", "votes")
    per = voted.groupBy("doc_id").agg(F.array_sort(F.collect_list(key)).alias("x"))
    begin = F.slice("x", 1, 0)

    def step(acc, c):
        clash = F.exists(acc, lambda t: (t["start"] < c["end"]) & (c["start"] < t["end"]))
        return F.when(clash, acc).otherwise(F.concat(acc, F.array(c)))

    kept = per.select("doc_id", F.explode(F.aggregate("x", begin, step)).alias("c"))
    return kept.select("doc_id", "c.text", "c.type", "c.start", "c.end", "c.assertions", "c.votes")


def vote(samples: DataFrame, min_votes: int = 2) -> DataFrame:
    return resolve_overlaps(vote_counts(ground(samples), min_votes))


# --- W7: windows


def windows(docs: DataFrame, target: int = 1200) -> DataFrame:
    """Line windows of at most ``target`` characters (one line at least): doc_id, window, w0, w1."""
    line = F.struct("start", "end", F.lit(1).alias("n"))
    per = newline_spans(docs).groupBy("doc_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    cut = packed(F.col("lines"), lambda run, x: x["end"] - run["start"] <= target)
    return per.select("doc_id", F.posexplode(cut).alias("window", "w")).select("doc_id", "window", F.col("w.start").alias("w0"), F.col("w.end").alias("w1"))


def labelled_chunks(annotated: DataFrame, target: int = 1200) -> DataFrame:
    """W7 for documents with their concepts beside them: nothing is joined or shuffled."""
    inside = arrow_column(lambda raw, starts, ends, kind: windows_of(raw, starts, ends, target, kind), WINDOWS, "raw", *_bounds())
    rows = annotated.select("doc_id", "raw", "concepts", inside.alias("w")).select("doc_id", "raw", "concepts", F.explode("w").alias("w"))
    w0, w1 = F.col("w.w0"), F.col("w.w1")
    none = F.array().cast("array<string>")
    made = lambda c: F.struct((c["start"] - w0).alias("start"), (c["end"] - w0).alias("end"), c["text"].alias("text"), c["type"].alias("type"), c["assertions"].alias("assertions"), none.alias("candidates"))
    own = F.transform("w.members", lambda i: made(F.get("concepts", i)))
    return rows.select("doc_id", F.col("w.window").alias("window"), F.substring(F.col("raw"), w0 + 1, w1 - w0).alias("text"), own.alias("concepts"))


def chunk_labelled(docs: DataFrame, concepts: DataFrame, target: int = 1200) -> DataFrame:
    """Windows with at least one concept wholly inside: doc_id, window, text, concepts (rebased, candidates cleared)."""
    return labelled_chunks(beside(docs.select("doc_id", "raw"), concepts), target)


def _bounds() -> list[Column]:
    return [F.transform("concepts", lambda c: c["start"].cast("int")), F.transform("concepts", lambda c: c["end"].cast("int"))]


# --- W8-W13


def is_garbage(text: Column) -> Column:
    """Fragments, marks and digits only, or a phrase that is no concept."""
    t = strip(text)
    return (F.length(t) <= 2) | t.rlike(r"(?U)^[\W\d_]+\z") | normalize(t).isin(sorted({normalize_literal(x) for x in FILLERS}))


def cleaned(annotated: DataFrame) -> DataFrame:
    """W10 for documents with their concepts beside them, without knowledge bases; other columns are kept."""
    kinds = F.transform("concepts", lambda c: c["type"])
    left = arrow_column(lambda raw, starts, ends, types, kind: tidied(raw, starts, ends, types, True, kind), TIDIED, "raw", *_bounds(), kinds)
    return annotated.withColumn("_t", left).withColumn("concepts", _tidy(annotated)).drop("_t")


def _tidy(annotated: DataFrame) -> Column:
    changed = {"text", "start", "end"}
    names = annotated.schema["concepts"].dataType.elementType.names

    def one(t):
        c = F.get("concepts", t["i"])
        return F.struct(*[(t if n in changed else c)[n].alias(n) for n in names])

    return F.transform("_t", one)


def clean_concepts(concepts: DataFrame, docs: DataFrame, drug_kb: DataFrame | None = None, disease_kb: DataFrame | None = None, settings: Settings = Settings(), fuzzy: bool = True) -> DataFrame:
    """W10 (and W9 if knowledge bases are given): strip, drop empty and garbage, one of equal (start, end, type), the first by ``ord``."""
    texts = docs.select("doc_id", "raw")
    annotated = beside(texts, concepts)
    if drug_kb is not None:
        kinds = F.transform("concepts", lambda c: c["type"])
        left = arrow_column(lambda raw, starts, ends, types, kind: tidied(raw, starts, ends, types, False, kind), TIDIED, "raw", *_bounds(), kinds)
        stripped = flat(annotated.withColumn("_t", left).withColumn("concepts", _tidy(annotated)))
        annotated = beside(texts, kb_trim(stripped, drug_kb, disease_kb, settings, fuzzy).withColumn("end", F.col("start") + F.length("text")))
    return flat(cleaned(annotated)).select(*concepts.columns)


def kb_trim(rows: DataFrame, drug_kb: DataFrame, disease_kb: DataFrame, settings: Settings = Settings(), fuzzy: bool = True) -> DataFrame:
    """A drug or diagnosis that cannot be linked shrinks to its longest linkable run of leading words, never below one."""
    from .link import link_terms

    out = rows.where(~F.col("type").isin(*LINKABLE))
    for kind, name, kb in ((DRUG, "drug", drug_kb), (DIAGNOSIS, "disease", disease_kb)):
        own = rows.where(F.col("type") == kind)
        texts = own.select("text").distinct()
        n = n_words(F.col("text"))
        prefix = F.regexp_substr(F.col("text"), F.concat(F.lit(f"(?U)^(?:{WS}*\\S+){{"), F.col("k").cast("string"), F.lit("}")))
        tried = texts.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(1), F.greatest(F.col("n"), F.lit(1))))).withColumn("part", F.when(F.col("k") == F.col("n"), F.col("text")).otherwise(prefix))
        linked = link_terms(tried.select(F.col("part").alias("text")), kb, name, settings, fuzzy=fuzzy).where(F.size("codes") > 0).select(F.col("text").alias("part"))
        best = tried.join(linked, "part").groupBy("text").agg(F.max_by("part", "k").alias("_best"))
        joined = own.join(best, "text", "left")
        text, start = strip_span(F.col("_best"), F.col("start"))
        shrunk = F.col("_best").isNotNull() & (F.col("_best") != F.col("text"))
        joined = bind(joined, text=F.when(shrunk, text).otherwise(F.col("text")), start=F.when(shrunk, start).otherwise(F.col("start")))
        out = out.unionByName(joined.select(*rows.columns))
    return out


def well_grounded(annotated: DataFrame, least: int = 4) -> DataFrame:
    """W11 for documents with their concepts beside them."""
    good = F.filter("concepts", lambda c: is_grounded(F.col("raw"), c["text"], c["start"], c["end"]))
    return annotated.where(F.size(good) >= least)


def quality_filter(notes: DataFrame, concepts: DataFrame, least: int = 4) -> DataFrame:
    """Notes (doc_id, raw) with at least ``least`` grounded concepts."""
    own = concepts.select("doc_id", F.lit(0).alias("ord"), "text", "start", "end")
    return well_grounded(beside(notes, own), least).select(*notes.columns)


def assertion_examples(labelled: DataFrame) -> DataFrame:
    """(text, y) of each assertable concept of (doc_id, text, concepts)."""
    rows = labelled.select(F.col("text").alias("raw"), F.explode("concepts").alias("c")).where(F.col("c.type").isin(ASSERTABLE))
    return rows.select(mark(F.col("raw"), F.col("c.start"), F.col("c.end")).alias("text"), multi_hot(F.col("c.assertions")).alias("y"))


def prepare(docs: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cleaned distant labels, counts per type before and after cleaning)."""
    raw = distant_label(docs, index)
    clean = clean_concepts(raw, docs)
    before, after = raw.groupBy("type").agg(F.count("*").alias("before")), clean.groupBy("type").agg(F.count("*").alias("after"))
    return clean, before.join(after, "type", "full_outer").na.fill(0)


def silver(docs: DataFrame, samples: DataFrame, min_votes: int = 2, target: int = 1200) -> DataFrame:
    """W14 after generation: vote over the samples (doc_id, sample, marked), cut to windows named ``<doc>_w<k>``."""
    voted = vote(samples.join(docs.select("doc_id", "raw"), "doc_id"), min_votes)
    chunks = chunk_labelled(docs, voted.withColumn("ord", F.struct("start", "end", "type")), target)
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("window")) - 1
    return chunks.select(F.concat(F.col("doc_id").cast("string"), F.lit("_w"), k.cast("string")).alias("doc_id"), "text", "concepts")
