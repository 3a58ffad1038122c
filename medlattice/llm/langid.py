"""Language identification by multilingual mixture inference.

A document is a mixture of languages.  Each word (a run of letters) has one likelihood per language, the product of
smoothed letter-trigram probabilities; expectation-maximisation over the words estimates the document's language
proportions.  Nested language sets (the most probable 1, 2, ... languages, up to all) are compared by log-likelihood less a
penalty of ``0.5 * penalty * (set size - 1) * log(words)``; the best set gives the prediction.

Cost and scale: training reads a bounded sample (``rows_per_lang`` labelled rows per language, chosen by a hash of the
key) and gathers languages x 65,536 counts, whatever the corpus size; every language that has a label is learnt, and more
than ``MAX_LANGUAGES`` of them, too many for a table of 256 KB each, are an error and not a cut.  Prediction is one map
over the documents without any shuffle.

Defined results: null or empty text, text without letters -> ``und`` with score 0 and empty mixture; text of letters never
seen in training -> the most frequent training language is preferred (ties go to the first language by name); no labelled
rows at all -> every row is ``und``.  Texts of any length are read whole.  Rows are independent: repeated rows get equal
results, null keys are sampled like others.  An empty table gives no rows.  Kept columns stay as they are: where one has
the name of a result, the result's name gets underscores (``free_name``); other columns are not read.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import blocks, free_name, map_rows

BUCKETS, MAX_LANGUAGES = 1 << 16, 2048
_BLOCK_CHARS = 1_000_000
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def word_trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets of all letters, start index of each word in them, document of each word."""
    lowered = [(t or "").lower() for t in texts]
    joined = "\n".join(lowered)
    code = np.frombuffer(("\n" + joined + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[code]
    code = np.where(letter, code, 0).astype(np.uint32)
    at = np.flatnonzero(letter)
    if not len(at):
        return np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        h = code[at - 1] * np.uint32(0x9E3779B1) + code[at] * np.uint32(0x85EBCA77) + code[at + 1] * np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
    starts = np.flatnonzero(~letter[at - 1])
    ends = np.cumsum([len(t) + 1 for t in lowered])
    return h >> np.uint32(16), starts, np.searchsorted(ends, at[starts], side="right")


class Model:
    """Languages, their log-probability table (languages x buckets) and prior log-probabilities."""

    def __init__(self, langs: list[str], counts: np.ndarray, rows: np.ndarray, smooth: float = 0.5):
        self.langs = langs
        total = counts.sum(axis=0, keepdims=True) + smooth * BUCKETS
        self.logp = np.ascontiguousarray(np.log((counts + smooth) / total).T, dtype=np.float32)
        self.prior = np.log((rows + 1.0) / (rows.sum() + len(langs))) if langs else np.zeros(0)

    def predict(self, texts: list[str | None], max_set: int | None, rounds: int, penalty: float):
        """Per text: (language, score, languages of the chosen set, their proportions)."""
        out: list[tuple[str, float, list[str], list[float]]] = []
        for lo, hi in blocks(texts, _BLOCK_CHARS):
            out += self._block(texts[lo:hi], max_set, rounds, penalty)
        return out

    def _block(self, texts, max_set, rounds, penalty):
        none = ("und", 0.0, [], [])
        grams, starts, doc = word_trigrams(texts)
        if not len(starts) or not self.langs:
            return [none] * len(texts)
        ll = np.stack([np.add.reduceat(row[grams], starts) for row in self.logp])  # languages x words
        best = ll.max(axis=0)
        like = np.exp(ll - best)
        docs, first = np.unique(doc, return_index=True)
        words = np.diff(np.append(first, len(doc)))
        base = np.add.reduceat(best.astype(np.float64), first)

        def fit(use: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """EM for the documents ``use`` (indices), each within its own languages (documents x languages)."""
            n, theta = words[use], mask / mask.sum(axis=1, keepdims=True)
            begin = np.concatenate(([0], np.cumsum(n)[:-1]))
            own = like[:, np.repeat(first[use] - begin, n) + np.arange(n.sum())] if len(use) < len(docs) else like
            for _ in range(rounds):
                r = own * np.repeat(theta.T.astype(np.float32), n, axis=1)
                r /= np.maximum(r.sum(axis=0), 1e-30)
                theta = np.stack([np.add.reduceat(x, begin) for x in r], axis=1).astype(np.float64) / n[:, None]
            mix = np.log(np.maximum((own * np.repeat(theta.T.astype(np.float32), n, axis=1)).sum(axis=0), 1e-30).astype(np.float64))
            return theta, np.add.reduceat(mix, begin) + base[use]

        n, every = len(self.langs), np.arange(len(docs))
        theta, full = fit(every, np.ones((len(docs), n)))
        # equal proportions: the more frequent, then the first language by name
        order = np.argsort(-(theta + 1e-9 * np.exp(self.prior)), axis=1, kind="stable")
        cost = 0.5 * penalty * np.log(np.maximum(words, 2))
        chosen, value = np.zeros((len(docs), n)), np.full(len(docs), -np.inf)
        for k in range(1, (n if max_set is None else min(n, max_set)) + 1):
            # no mixture beats the sum of each word's best language: sets that could not win even then need no fit
            use = every if k == 1 else np.flatnonzero(base - cost * (k - 1) > value)
            if not len(use):
                break
            if k == 1:
                sums = np.add.reduceat(ll.astype(np.float64), first, axis=1)
                th = np.zeros((len(docs), n))
                np.put_along_axis(th, order[:, :1], 1.0, axis=1)
                lik = sums[order[:, 0], every]
            elif k == n:
                th, lik = theta[use], full[use]
            else:
                mask = np.zeros((len(use), n))
                np.put_along_axis(mask, order[use, :k], 1.0, axis=1)
                th, lik = fit(use, mask)
            lik = lik - cost[use] * (k - 1)
            better = lik > value[use] + 1e-9
            chosen[use[better]], value[use[better]] = th[better], lik[better]
        out = [none] * len(texts)
        top = np.argmax(chosen + 1e-9 * np.exp(self.prior), axis=1)
        for i, d in enumerate(docs):
            own = [j for j in order[i] if chosen[i, j] > 0]
            out[d] = (self.langs[top[i]], float(min(1.0, chosen[i, top[i]])), [self.langs[j] for j in own], [float(chosen[i, j]) for j in own])
        return out


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows_per_lang: int = 1500) -> Model:
    """Learn from at most about ``rows_per_lang`` rows of each language.

    The sample is the rows whose key hashes below a per-language threshold, so it is spread over all partitions.
    Rows without a language or text teach nothing.
    """
    labelled = labelled.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where("l is not null and t is not null")
    n = {r["l"]: r["n"] for r in labelled.groupBy("l").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(n) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs = sorted(n)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    scale = 1 << 30
    keep = F.create_map(*[F.lit(x) for v in langs for x in (v, int(min(1.0, rows_per_lang / n[v]) * scale))])
    sample = labelled.where(F.pmod(F.xxhash64("k", F.lit("langid")), F.lit(scale)) < F.try_element_at(keep, F.col("l"))).select("l", "t")

    def count(cols):
        li, bi, ci = [], [], []
        for v in sorted(set(cols["l"])):
            grams, _, _ = word_trigrams([t for t, x in zip(cols["t"], cols["l"]) if x == v])
            b, c = np.unique(grams, return_counts=True)
            li += [v] * len(b)
            bi += b.tolist()
            ci += c.tolist()
        return {"l": li, "b": bi, "c": ci}

    counted = map_rows(sample, count, "l string, b int, c bigint").groupBy("l", "b").agg(F.sum("c").alias("c")).toArrow()
    counts, at = np.zeros((BUCKETS, len(langs))), {v: i for i, v in enumerate(langs)}
    if counted.num_rows:
        counts[counted["b"].to_numpy(), [at[v] for v in counted["l"].to_pylist()]] = counted["c"].to_numpy()
    return Model(langs, counts, np.array([n[v] for v in langs], float))


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text", max_set: int | None = None, rounds: int = 8, penalty: float = 1.0) -> DataFrame:
    """Columns ``keep`` of ``docs`` plus lang_pred, score, langs, proportions (or the next free names); one row per row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # languages x 256 KB, independent of the corpus
    types = dict(docs.dtypes)
    names = [free_name(n, keep) for n in ("lang_pred", "score", "langs", "proportions")]
    made = [f"`{n}` {t}" for n, t in zip(names, ("string", "double", "array<string>", "array<double>"))]

    def run(cols):
        rows = shipped.value.predict(cols[text], max_set, rounds, penalty)
        return {c: cols[c] for c in keep} | {n: [r[i] for r in rows] for i, n in enumerate(names)}

    return map_rows(docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])]), run, ", ".join([*[f"`{c}` {types[c]}" for c in keep], *made]))


def with_letters(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text has a letter: those that a model of any languages would not call ``und``."""

    def run(cols):
        own = [i for i, t in enumerate(cols[text]) if any(map(str.isalpha, (t or "").lower()))]
        return {c: [v[i] for i in own] for c, v in cols.items()}

    return map_rows(docs, run, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes))
