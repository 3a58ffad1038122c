"""Language-model scoring by a hidden Markov model over words.

States emit symbols: the end of a text and every frequent word (at least ``HEAD`` of all training tokens, so at most
1 / HEAD words) are symbols of their own; any other word belongs to one of ``CLASSES`` classes by its last two characters
and has there the probability (count + 1) / (class tokens + class words + 1), the one left over being that of unseen words.
Baum-Welch expected counts are computed per block of sequences, added up across partitions, and normalised; after a start
on a bounded sample every round runs over all training tokens.  The score is the exact log10 likelihood from the scaled
forward recursion over the whole text and its end.

Scale: word counts come from one shuffle of per-task counts.  Words of at least ``KNOWN`` of the tokens (at most
1 / KNOWN of them) are looked up in a broadcast table; the rest of each text's words are joined to the counts by
word.  Texts are split into words twice, then kept as packed symbols.  What a task sends for a round is states x
symbols numbers, at most 8 x 10,258, whatever the corpus.

Training counts each token and each transition once, in pieces of ``PIECE`` tokens so that memory is bounded; a piece is
read with ``CONTEXT`` tokens on both sides, which are not counted in it but let its states settle.  Scoring never splits.
The recursions go through an Arrow batch's sequences side by side, so a step's cost is shared by as many as are that long;
memory is bounded by ``_BLOCK_TOKENS``, in training by whole pieces, in scoring by windows of steps.
Defined results: null and empty texts are only an end; very long texts are scored whole; without training rows every count
is 0, the base score is 0 and all symbols are equally likely; repeated rows, null ids too, are scored alike; equal counts
(ties) need no order; an empty table gives no rows; columns other than doc_id, held_out and text are not read.
"""
from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_table

STATES, HEAD, KNOWN, CLASSES, PIECE, CONTEXT = 8, 1e-4, 2e-6, 256, 1024, 16
SAMPLE_TOKENS, SAMPLE_ROUNDS, CORPUS_ROUNDS = 200_000, 15, 3
#: Tokens of the overall distribution that each state is given beforehand; they keep a small corpus from being learnt by heart.
PRIOR = 100.0
END = b""  # no word is empty
#: Tokens that are computed side by side; a longer sequence is a block of its own.
_BLOCK_TOKENS = 200_000
#: Steps after which the forward recursion is scaled; between them it falls by no more than the smallest transition a step.
_SCALED = 8


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lower-cased, cut at ASCII white space: bytes know no other letters and spaces."""
    return (text or b"").lower().split()


def word_class(word: bytes) -> int:
    tail = word[-2:]
    if not tail.isascii():
        tail = word.decode("utf-8", "replace")[-2:].encode()
    return zlib.crc32(tail) % CLASSES


class Hmm:
    """Start, transition and emission probabilities (symbols x states), and the overall distribution of states."""

    def __init__(self, start, move, emit, overall):
        self.start, self.move, self.emit, self.overall = start, move, emit, overall

    @classmethod
    def begin(cls, weight: np.ndarray, states: int = STATES, seed: int = 1) -> Hmm:
        """Sticky transitions; emissions near the symbols' shares, disturbed so that states can part."""
        rng = np.random.default_rng(seed)
        emit = (weight[:, None] + 1e-9) * rng.uniform(0.5, 1.5, (len(weight), states))
        move = np.full((states, states), 0.05 / max(1, states - 1))
        np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
        even = np.full(states, 1 / states)
        return cls(even, move, emit / emit.sum(axis=0), even)

    @classmethod
    def from_counts(cls, start, move, emit, weight: np.ndarray) -> Hmm:
        """Normalised counts, smoothed: emissions by a little of the symbols' overall shares."""
        states = len(start)
        overall = emit.sum(axis=0) + 1e-6
        emit = emit + PRIOR * (weight[:, None] + 1e-9)
        start, move = start + 0.1, move + 0.1
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0), overall / overall.sum())


class _Packed:
    """Sequences side by side, by falling length, without padding: the symbols of all at time 0, then of all at time 1, and so on."""

    def __init__(self, seqs: list[np.ndarray]):
        length = np.array([len(s) for s in seqs])
        self.order = np.argsort(-length, kind="stable")
        self.length = length[self.order]
        self.begin = np.cumsum(self.length) - self.length
        self.flat = np.concatenate([seqs[i] for i in self.order])
        self.alive = np.searchsorted(-self.length, -np.arange(self.length[0]), side="left")
        self.at = np.concatenate(([0], np.cumsum(self.alive)))
        rank = np.repeat(np.arange(len(seqs)), self.length)
        self.time = np.arange(len(self.flat)) - self.begin[rank]
        self.place = self.at[self.time] + rank

    def packed(self, values: np.ndarray) -> np.ndarray:
        """One value a token, sequence by sequence, in the packed order."""
        out = np.empty_like(values)
        out[self.place] = values
        return out


def in_blocks(seqs: list[np.ndarray], tokens: int = _BLOCK_TOKENS) -> Iterator[list[int]]:
    """Indices in groups of like length, each of at most ``tokens`` tokens, or one sequence."""
    held, size = [], 0
    for i in sorted(range(len(seqs)), key=lambda i: -len(seqs[i])):
        if held and size + len(seqs[i]) > tokens:
            yield held
            held, size = [], 0
        held.append(i)
        size += len(seqs[i])
    if held:
        yield held


def log_likelihoods(model: Hmm, seqs: list[np.ndarray]) -> np.ndarray:
    """Natural log-likelihood of each symbol sequence: forward recursion, scaled as it goes."""
    length = np.array([len(s) for s in seqs], np.int64)
    order = np.argsort(-length, kind="stable")
    largest = model.emit.max(axis=1, keepdims=True)
    emit, log_largest, one = model.emit / largest, np.log(largest[:, 0]), np.ones(len(model.start))
    a, ll = np.repeat(model.start[None, :], len(seqs), axis=0), np.zeros(len(seqs))
    moved, done, n = np.empty_like(a), 0, len(seqs)
    while n:  # some steps of all sequences that are as long
        steps = max(1, _BLOCK_TOKENS // n)
        p = _Packed([seqs[i][done : done + steps] for i in order[:n]])
        ahead, at = emit[p.packed(p.flat)], p.at.tolist()
        ll[:n] += np.add.reduceat(log_largest[p.flat], p.begin)
        for t in range(len(p.alive)):
            now = ahead[at[t] : at[t + 1]]
            alive = a[: len(now)]
            if done + t:
                np.multiply(np.matmul(alive, model.move, out=moved[: len(now)]), now, out=alive)
            else:
                alive *= now
            if (done + t) % _SCALED == _SCALED - 1:
                c = alive @ one
                alive /= c[:, None]
                ll[: len(now)] += np.log(c)
        done += steps
        n = int((length > done).sum())
    out = np.empty(len(seqs))
    out[order] = ll + np.log(a @ one)
    return out


def expected_counts(model: Hmm, seqs: list[np.ndarray], fresh: list[bool], spans: list[tuple[int, int]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts (start, move, emit) of sequences; those that are not ``fresh`` are later pieces of a text.

    Of each sequence the tokens within its span are counted, and the transitions into them; all of it without spans.
    """
    states, symbols = len(model.start), len(model.emit)
    start, pairs, emit = np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states))
    spans = spans or [(0, len(s)) for s in seqs]
    share = model.emit / model.emit.max(axis=1, keepdims=True)  # a factor of all states at once leaves the counts as they are
    back, one = np.ascontiguousarray(model.move.T), np.ones(states)
    for block in in_blocks(seqs):
        p = _Packed([seqs[i] for i in block])
        symbol, at, last = p.packed(p.flat), p.at.tolist(), len(p.alive) - 1
        new = np.array([fresh[block[i]] for i in p.order])
        first, end = (np.repeat(x, p.length) for x in np.array([spans[block[i]] for i in p.order]).T)
        counted = p.packed((first <= p.time) & (p.time < end))
        whole = (np.add.reduceat(counted, p.at[:-1], dtype=np.int64) == p.alive).tolist()
        x = share[symbol]  # emissions, later those times the backward values
        f = np.empty_like(x)  # forward, later expected states
        scale = {}
        for t in range(last + 1):
            here, now = f[at[t] : at[t + 1]], x[at[t] : at[t + 1]]
            if t:
                np.matmul(f[at[t - 1] : at[t - 1] + len(here)], model.move, out=here)
                here *= now
            else:
                np.multiply(np.where(new[:, None], model.start, model.overall), now, out=here)
            if t % _SCALED == _SCALED - 1:
                scale[t] = (here @ one)[:, None]
                here /= scale[t]
        b = np.repeat(1 / (f[p.at[p.length - 1] + np.arange(len(block))] @ one)[:, None], states, axis=1)
        for t in range(last, -1, -1):
            here, now = f[at[t] : at[t + 1]], x[at[t] : at[t + 1]]
            alive = b[: len(here)]
            if t:
                now *= alive
                if t in scale:
                    now /= scale[t]
                into = now if whole[t] else now * counted[at[t] : at[t + 1], None]
                pairs += f[at[t - 1] : at[t - 1] + len(here)].T @ into
            here *= alive
            if t:
                np.matmul(now, back, out=alive)
        start += (f[: at[1]] * counted[: at[1], None])[new].sum(axis=0)
        kept = np.where(counted, symbol, symbols).astype(np.intp)
        for s in range(states):
            emit[:, s] += np.bincount(kept, weights=f[:, s], minlength=symbols + 1)[:symbols]
    return start, pairs * model.move, emit


def pieces(seqs: list[np.ndarray]) -> tuple[list[np.ndarray], list[bool], list[tuple[int, int]]]:
    """Pieces with their context, whether each begins its text, and the span of each that counts."""
    out, fresh, spans = [], [], []
    for s in seqs:
        for lo in range(0, len(s), PIECE):
            begin = max(0, lo - CONTEXT)
            out.append(s[begin : lo + PIECE + CONTEXT])
            fresh.append(lo == 0)
            spans.append((lo - begin, min(lo + PIECE, len(s)) - begin))
    return out, fresh, spans


# --- over DataFrames


def _slices(it: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def _bytes(column: pa.Array) -> list[bytes | None]:
    """Texts as their UTF-8 bytes."""
    return column.cast(pa.large_binary()).to_pylist()


def _sequences(column: pa.Array) -> list[np.ndarray]:
    """Packed symbols as arrays that share the column's memory."""
    return [np.frombuffer(x.as_buffer(), np.uint16) for x in column]


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) over all ``texts`` (column text), the end among them; each task sends its distinct words, flushed at a bounded number."""
    target = pa.schema([("word", pa.string()), ("c", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for part in _slices(it, 256):
            for t in _bytes(part.column(0)):
                held.update(words_of(t))
            held[END] += part.num_rows
            if len(held) > 150_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], schema=target)
                held.clear()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], schema=target)

    return texts.select("text").mapInArrow(run, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def symbolise(docs: DataFrame, known: dict[bytes, int], head: dict[bytes, int]) -> DataFrame:
    """Per row: uid, doc_id, held_out, symbols (packed), classes (packed, of the words that are no symbol of their own),
    n_tokens, known_n and known_log (over words of the broadcast table), known_tail (their part outside the symbols), rest (the other words)."""
    from pyspark import TaskContext

    shipped = docs.sparkSession.sparkContext.broadcast((known, head))  # at most 1 / KNOWN words
    target = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("symbols", pa.binary()), ("n_tokens", pa.int64()), ("known_n", pa.int64()), ("known_log", pa.float64()), ("known_tail", pa.float64()), ("rest", pa.list_(pa.string()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, head = shipped.value
        uid = TaskContext.get().partitionId() << 36
        base = len(head)
        names = list(known) + [w for w in head if w not in known]  # the end too, if there are no training rows
        number = {w: i for i, w in enumerate(names)}
        # of each number, and then of each class, which stands for all other words
        symbol = np.array([head[w] if w in head else base + word_class(w) for w in names] + [base + k for k in range(CLASSES)], np.uint16)
        logs = np.array([math.log10(known[w] + 1) if w in known else 0.0 for w in names] + [0.0] * CLASSES)
        tail, tails = np.where(symbol >= base, logs, 0.0), _Tails()
        for part in _slices(it, 256):
            words, ends = [], []
            for text in _bytes(part.column(2)):
                words += words_of(text)
                words.append(END)
                ends.append(len(words))
            n = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))
            other = (n < 0) | (n >= len(known))
            n[n < 0] = len(names) + np.array([tails.word_class(w) for w in compress(words, (n < 0).tolist())], np.int64)
            begins = np.array([0, *ends])
            others = np.concatenate(([0], np.cumsum(other)))[begins]
            total = np.diff(begins)
            out = [
                pa.array(np.arange(uid, uid + part.num_rows)), *part.columns[:2],
                pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((begins * 2).astype(np.int32)), pa.py_buffer(symbol[n])]),
                pa.array(total), pa.array(total - np.diff(others)), pa.array(np.add.reduceat(logs[n], begins[:-1])), pa.array(np.add.reduceat(tail[n], begins[:-1])),
                pa.ListArray.from_arrays(pa.array(others, pa.int32()), pa.array(list(compress(words, other.tolist())), pa.string())),
            ]
            uid += part.num_rows
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out, target)], schema=target)

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "uid bigint, doc_id bigint, held_out boolean, symbols binary, n_tokens bigint, known_n bigint, known_log double, known_tail double, rest array<string>")


class _Tails(dict):
    """Classes by the last two bytes, where those are characters; other words are looked at whole."""

    def word_class(self, word: bytes) -> int:
        found = self.get(word[-2:])
        if found is None:
            found = word_class(word)
            if word[-2:].isascii():
                self[word[-2:]] = found
        return found


def corpus_counts(symbols: DataFrame, model: Hmm) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts over all training rows: summed in each task, then across tasks by a two-step aggregation of rows."""
    shipped = symbols.sparkSession.sparkContext.broadcast(model)
    states, n = len(model.start), len(model.emit)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, total = shipped.value, None
        for part in it:
            cut = pieces(_sequences(part.column(0)))
            if cut[0]:
                start, move, emit = expected_counts(m, *cut)
                all_ = np.concatenate((start[None, :], move, emit))
                total = all_ if total is None else total + all_
        if total is not None:
            rows = np.flatnonzero(total.sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *[pa.array(total[rows, s]) for s in range(states)]], names=["row", *[f"s{s}" for s in range(states)]])

    sums = symbols.where("not held_out").select("symbols").mapInArrow(run, "row int, " + ", ".join(f"s{s} double" for s in range(states)))
    got = sums.groupBy("row").agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in range(states)]).toArrow()
    total = np.zeros((1 + states + n, states))
    if got.num_rows:
        total[got["row"].to_numpy()] = np.stack([got[f"s{s}"].to_numpy() for s in range(states)], axis=1)
    return total[0], total[1 : 1 + states], total[1 + states :]


def train(symbols: DataFrame, weight: np.ndarray, states: int = STATES, corpus_rounds: int = CORPUS_ROUNDS) -> Hmm:
    """A start on at most ``SAMPLE_TOKENS`` tokens of pieces of training rows, then rounds over the whole corpus."""
    model, scale = Hmm.begin(weight, states), 1 << 30
    training = symbols.where("not held_out")
    tokens = training.agg(F.sum("n_tokens")).first()[0] or 0
    share = max(1, int(min(1.0, SAMPLE_TOKENS / max(1, tokens)) * scale))  # pieces are drawn alike, wherever they lie and however long their text is
    drawn = lambda p: F.pmod(F.xxhash64("uid", p), F.lit(scale))
    every = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_tokens") - 1) / PIECE))
    # a text's pieces are cut from it only after the draw, with their context
    before = lambda p: F.when(p > 0, F.lit(CONTEXT)).otherwise(F.lit(0))
    part = lambda p: F.substring("symbols", ((p * PIECE - before(p)) * 2 + 1).cast("int"), ((before(p) + PIECE + CONTEXT) * 2).cast("int"))
    own = F.transform(F.filter(every, lambda p: drawn(p) < share), lambda p: F.struct(drawn(p).alias("h"), p.alias("piece"), part(p).alias("symbols")))
    sample = training.select("uid", F.explode(own).alias("s")).select("s.h", "uid", "s.piece", "s.symbols")
    got, seqs, fresh, spans = 0, [], [], []
    for r in sorted(sample.collect()):
        s, lead = np.frombuffer(bytes(r["symbols"]), np.uint16), CONTEXT if r["piece"] else 0
        span = (lead, min(len(s), lead + PIECE))
        if got + span[1] - lead <= SAMPLE_TOKENS:
            got += span[1] - lead
            seqs.append(s)
            fresh.append(r["piece"] == 0)
            spans.append(span)
    for _ in range(SAMPLE_ROUNDS if seqs else 0):
        model = Hmm.from_counts(*expected_counts(model, seqs, fresh, spans), weight)
    for _ in range(corpus_rounds):
        model = Hmm.from_counts(*corpus_counts(symbols, model), weight)
    return model


def score(docs: DataFrame, states: int = STATES) -> DataFrame:
    """``docs`` has doc_id, held_out, text; returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    counts = shared_table(count_words(docs.where("not held_out")), "lm-counts")
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = sums["n"], sums["v"]
    least = max(1.0, KNOWN * n)
    rare_word = (F.col("c") < least) & (F.col("word") != "")
    frequent = {r["word"].encode(): r["c"] for r in counts.where(~rare_word).collect()}  # at most 1 / KNOWN rows, and the end
    head = {w: i for i, w in enumerate(sorted({w for w, c in frequent.items() if c >= HEAD * n} | {END}))}  # the end is always a symbol
    outside = counts.where(F.col("c") < HEAD * n)
    cls = F.pmod(F.crc32(F.encode(F.right("word", F.lit(2)), "UTF-8")), F.lit(CLASSES)).cast("int")
    per_class = {r["k"]: (r["c"], r["v"]) for r in outside.where(F.col("word") != "").groupBy(cls.alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()}
    tokens = np.array([per_class.get(k, (0, 0))[0] for k in range(CLASSES)], float)
    size = np.array([sum(per_class.get(k, (0, 0))) + 1 for k in range(CLASSES)], float)  # tokens + words + 1
    weight = np.array([frequent.get(w, 0) for w in head] + tokens.tolist(), float)
    weight = (weight + 0.5) / (weight + 0.5).sum()

    symbols = shared_table(symbolise(docs, frequent, head), "lm-symbols")
    model = train(symbols, weight, states)
    shipped = spark.sparkContext.broadcast((model, np.log10(size), len(head)))
    names = ["uid", "doc_id", "held_out", "n_tokens", "known_n", "known_log", "known_tail"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, log_size, base = shipped.value
        size = np.concatenate((np.zeros(base), log_size))
        for part in it:
            seqs = _sequences(part.column(len(names)))
            ll = log_likelihoods(m, seqs) / math.log(10)
            within = np.array([size[s].sum() for s in seqs])
            yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(ll - within)], names=[*names, "forward"])

    scored = symbols.select(*names, "symbols").mapInArrow(run, "uid bigint, doc_id bigint, held_out boolean, n_tokens bigint, known_n bigint, known_log double, known_tail double, forward double")
    rest = symbols.select("uid", F.explode("rest").alias("word")).join(counts.where(rare_word), "word")
    rare = rest.groupBy("uid").agg(F.sum(F.log10(F.col("c") + 1.0)).alias("rare_log"), F.count("*").alias("rare_n"))
    base = math.log10(n + v + 1)
    some = lambda c: F.coalesce(c, F.lit(0))
    return scored.join(rare, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known_n") + some(F.col("rare_n"))).alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("known_log") + some(F.col("rare_log")) - F.col("n_tokens") * F.lit(base)).alias("base_score"),
        (F.col("forward") + F.col("known_tail") + some(F.col("rare_log"))).alias("score"),
    )
