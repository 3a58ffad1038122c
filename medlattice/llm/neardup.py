"""Near-duplicate detection by Order MinHash, verified by banded alignment.

The k-mers of a document are its shingles of five words, each labelled with its occurrence number.  One sketch takes the
``PICK`` k-mers of least hash and keeps them in text order, so two documents agree on it only if they share those
k-mers in the same order.  ``ROWS`` sketches make a band key; documents that share one of ``BANDS`` keys are candidates.

Similarity of a pair: s / (a + b - s) for a and b words, of which s are matched, in order, by the best alignment inside
the band of offsets that could still reach the threshold: an edit similarity over words.  Pairs of ``THRESHOLD`` (0.8) or
more are linked; classes are the connected components, named by their least document.  Texts whose shingles match in order
with a similarity of 0.8 are linked too, as their words match at least as well.

Recall: a pair whose shingles have the Jaccard similarity J shares a key with probability of about 1 - (1 - J**4)**36:
0.9999 at 0.7, 0.99 at 0.6, 0.90 at 0.5, 0.25 at 0.3.  A copy with 5 % of its words changed has J of about 0.63 to its
original, two such copies 0.43 to each other; they meet through the original.  ``tests/llm`` measure it on planted edits.

Scale: equal texts (by words) are collapsed first, whatever their number.  Within a key the members are compared with its
best connected member only, each member first with the best of its representatives; what is connected by then is not
compared again, so a large group of near copies costs about one comparison a member.  Members that fail are compared in
blocks with all members of the key that are not yet connected to them, those connected to the representative too, so no
link that shares a key is lost.  Such a rest of a key costs its size times the key's, in bounded tasks that emit links
alone; within a block one matrix product of word counts bounds every pair's matches, and only pairs that can reach the
threshold are aligned.  Members and representatives meet in salted groups of at most about ``GROUP`` members, read as a
stream.  What bands and representatives are joined with is a written table with one row a key: small ones need no shuffle
of the other side, and adaptive execution splits a hot key of large ones.  Classes are found by minimum labels with
pointer jumping, in tables; nothing about documents is collected to the driver.  Different texts are numbered in a
written table, so no two of them can collide; words are compared by 32-bit hashes, equality by 128-bit digests.

Defined results: a null text is a class of its own; equal texts, the empty one too, are one class; texts of fewer than
five words have one shingle, all their words; very long texts are aligned whole, in time of length x band / 64; ties of
representatives go to the least document; repeated rows have equal results; rows that share a doc_id are told apart by
their words; rows without a doc_id are compared like all others, and a class of such rows alone has no least document,
so its name is null; an empty table gives no rows; other columns are not read and cannot clash.
"""
from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_shared, map_rows, shared_table

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS, PICK = 36, 2, 2
GROUP, BLOCK = 256, 256
_SEGMENT = 1 << 14

_rng = np.random.default_rng(20240607)
_XOR = _rng.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 31, (BANDS * ROWS, 1), dtype=np.uint32) * 2 + 1
_MIX = [int(x) | 1 for x in _rng.integers(1 << 40, 1 << 62, 8)]


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return h


_hashes = _WordHash()


def words_of(text: str) -> list[str]:
    return text.lower().split()


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint32, len(words))


def shingles(h: np.ndarray, k: int = WORDS) -> np.ndarray:
    """64-bit hashes of the runs of k words (given as their hashes), in text order; a shorter text has one shingle."""
    if len(h) < k:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes())], np.uint64)
    h = h.astype(np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            out = (out ^ h[i : len(h) - k + 1 + i]) * np.uint64(_MIX[i])
            out ^= out >> np.uint64(29)
    return out


def labelled(s: np.ndarray) -> np.ndarray:
    """32-bit hashes of (item, how many equal ones came before)."""
    if not len(s):
        return np.empty(0, np.uint32)
    order = np.argsort(s, kind="stable")
    ranked = s[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    at = np.arange(len(s))
    nth = np.empty(len(s), np.uint64)
    nth[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    with np.errstate(over="ignore"):
        x = (s.astype(np.uint64) + nth * np.uint64(_MIX[6])) * np.uint64(_MIX[7])
    return (x >> np.uint64(32)).astype(np.uint32)


def bands(s: np.ndarray) -> np.ndarray:
    """The band keys (int64) of a document's shingles."""
    x, n = labelled(s), len(s)
    if n == 1:
        picks = np.repeat(x[None, :], BANDS * ROWS, axis=0).astype(np.uint64)
    else:
        least = np.full((BANDS * ROWS, PICK), np.uint32(0xFFFFFFFF))
        where = np.zeros((BANDS * ROWS, PICK), np.int64)
        every = np.arange(BANDS * ROWS)
        for lo in range(0, n, _SEGMENT):
            h = (x[None, lo : lo + _SEGMENT] ^ _XOR) * _MUL
            h ^= h >> np.uint32(15)
            found, at = [least], [where]
            for _ in range(min(PICK, h.shape[1])):
                i = h.argmin(axis=1)
                found.append(h[every, i][:, None])
                at.append(i[:, None] + lo)
                h[every, i] = 0xFFFFFFFF
            found, at = np.concatenate(found, axis=1), np.concatenate(at, axis=1)
            keep = np.argsort(found, axis=1, kind="stable")[:, :PICK]
            least, where = np.take_along_axis(found, keep, axis=1), np.take_along_axis(at, keep, axis=1)
        picks = x[np.sort(where, axis=1)].astype(np.uint64)  # in text order
    key = np.zeros(BANDS, np.uint64)
    with np.errstate(over="ignore"):
        flat = picks.reshape(BANDS, -1)
        for j in range(flat.shape[1]):
            key = (key ^ flat[:, j]) * np.uint64(_MIX[j % 5])
            key ^= key >> np.uint64(31)
        key ^= np.arange(BANDS, dtype=np.uint64) * np.uint64(_MIX[5])
    return key.astype(np.int64)


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Most items matched in order with offsets of at most ``band``: bit-parallel longest common subsequence."""
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(same.argmin())
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    if not n:
        return head
    same = a[::-1][:n] == b[::-1][:n]
    tail = n if same.all() else int(same.argmin())
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    masks: dict[int, int] = {}
    common = np.isin(a, b)
    for i, s in zip(np.flatnonzero(common).tolist(), a[common].tolist()):
        masks[s] = masks.get(s, 0) | 1 << i
    full = (1 << len(a)) - 1
    v, window = full, (1 << (2 * band + 1)) - 1
    for j, s in enumerate(b.tolist()):
        m = masks.get(s)
        if m:
            m &= window << (j - band) if j >= band else window >> (band - j)
            u = v & m
            v = ((v + u) | (v - u)) & full
    return head + tail + len(a) - v.bit_count()


def needed(na: int, nb: int, threshold: float) -> float:
    """Matches that the threshold asks for."""
    return threshold * (na + nb) / (1 + threshold) - 1e-9


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Similarity of two sequences; 0.0 if the threshold is out of reach."""
    na, nb = len(a), len(b)
    need = needed(na, nb, threshold)
    if min(na, nb) < need:
        return 0.0
    if not na and not nb:
        return 1.0
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    if np.minimum(ca[ia], cb[ib]).sum() < need:
        return 0.0
    s = aligned(a, b, int(max(na, nb) - need) + 1)
    return s / (na + nb - s)


def overlaps(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """How many labelled items each of ``xs`` has in common with each of ``ys``: one matrix product a slice of items."""
    out = np.zeros((len(xs), len(ys)), np.float32)
    both = np.intersect1d(np.concatenate(xs), np.concatenate(ys)) if xs and ys else np.empty(0, np.uint32)
    for lo in range(0, len(both), 2048):
        part = both[lo : lo + 2048]

        def grid(own: list[np.ndarray], part=part) -> np.ndarray:
            g = np.zeros((len(own), len(part)), np.float32)
            for i, x in enumerate(own):
                at = np.minimum(np.searchsorted(part, x), len(part) - 1)
                g[i, at[part[at] == x]] = 1
            return g

        out += grid(xs) @ grid(ys).T
    return out


# --- over DataFrames


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc, text_key (hash of the text), words_key (digest of the words), words (their packed hashes), bands; rows without text are left out."""

    def run(cols):
        out: dict[str, list] = {"doc": cols["k"], "text_key": cols["h"], "words_key": [], "words": [], "bands": []}
        for t in cols["t"]:
            words = words_of(t)
            h = word_hashes(words)
            out["words_key"].append(xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass")))
            out["words"].append(h.tobytes())
            out["bands"].append(bands(shingles(h)))
        return out

    slim = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("h")).where("t is not null")
    return map_rows(slim, run, "doc bigint, text_key bigint, words_key binary, words binary, bands array<bigint>", slice_rows=256)


def verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(member, rep, ok) for the pairs (member, rep); ``texts`` has cls, words.

    Members travel with their words to (rep, salt) groups, and the representative is sent once to each group.
    """
    sizes = shared_table(pairs.groupBy("rep").agg(F.count("*").alias("n")), "dedup-reps")
    salted = pairs.join(sizes, "rep").select("rep", "member", F.pmod(F.xxhash64("member"), F.ceil(F.col("n") / GROUP)).cast("int").alias("salt"))
    members = salted.select("rep", "salt", "member", F.col("member").alias("cls"))
    reps = salted.select("rep", "salt", F.lit(None).cast("bigint").alias("member"), F.col("rep").alias("cls")).distinct()
    target = pa.schema([("member", pa.int64()), ("rep", pa.int64()), ("ok", pa.bool_())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, mine = None, None
        for batch in it:
            rep, member, data = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            out = []
            for i in range(batch.num_rows):
                s = np.frombuffer(data[i].as_py(), np.uint32)
                if member[i] is None:
                    held, mine = rep[i], s
                elif held == rep[i]:
                    out.append((member[i], held, similarity(mine, s, threshold) >= threshold - 1e-9))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), target)], schema=target)

    both = members.unionByName(reps).join(texts, "cls").repartition("rep", "salt").sortWithinPartitions("rep", "salt", F.col("member").asc_nulls_first())
    return both.select("rep", "member", "words").mapInArrow(run, "member bigint, rep bigint, ok boolean")


def components(links: DataFrame) -> DataFrame:
    """(cls, label): the least number of each connected component of (member, rep); only linked ones appear."""
    both = links.select(F.col("member").alias("a"), F.col("rep").alias("b")).unionByName(links.select(F.col("rep").alias("a"), F.col("member").alias("b")))
    edges = shared_table(both.distinct(), "dedup-edges")
    table = shared_table(edges.groupBy(F.col("a").alias("cls")).agg(F.least(F.col("cls"), F.min("b")).alias("label")), "dedup-labels")
    while True:
        labels = table.select("cls", "label")
        near = edges.join(labels, edges["b"] == labels["cls"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["cls"] == near["a"], "left").select("cls", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = labels.select(F.col("cls").alias("at"), F.col("label").alias("far"))
        moved = shared_table(step.join(jump, step["label"] == jump["at"], "left").select("cls", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "dedup-labels")
        drop_shared(table)
        table = moved
        if moved.where("label <> old").isEmpty():
            drop_shared(edges)
            return moved.select("cls", "label")


def discover(rows: DataFrame) -> DataFrame:
    """Of (cls, least, band) the members of each key with others, beside the key's representative: cls, least, band, rep, degree.

    The representative is the member that shares keys most often, then the least: among copies of a text that is most often
    the text itself, to which all of them are near even if they are not near to each other.
    """
    counts = shared_table(rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "dedup-counts")
    shared = shared_table(rows.join(counts, "band"), "dedup-shared")
    degree = shared.groupBy(F.col("cls").alias("_c")).agg(F.sum("n").alias("degree"))
    ranked = shared.join(degree, F.col("cls") == F.col("_c")).drop("_c")
    heads = shared_table(ranked.groupBy("band").agg(F.max(F.struct("degree", (-F.col("least")).alias("least"), "cls")).alias("h")).select("band", F.col("h.cls").alias("rep"), F.col("h.degree").alias("degree")), "dedup-heads")
    found = shared_table(shared.drop("n").join(heads, "band").where("cls <> rep").select("cls", "least", "band", "rep", "degree"), "dedup-open")
    for t in (counts, shared, heads):
        drop_shared(t)
    return found


class _Linker:
    """Compares members with their keys' representatives; knows what was tested and what is connected."""

    def __init__(self, texts: DataFrame, threshold: float):
        self.texts, self.threshold = texts, threshold
        self.tested: DataFrame | None = None
        self.labels: DataFrame | None = None

    def _apart(self, rows: DataFrame) -> DataFrame:
        """Rows (cls, rep) that are not yet in one component."""
        if self.labels is None:
            return rows
        a = self.labels.select("cls", F.col("label").alias("_a"))
        b = self.labels.select(F.col("cls").alias("rep"), F.col("label").alias("_b"))
        joined = rows.join(a, "cls", "left").join(b, "rep", "left")
        return joined.where(F.coalesce("_a", "cls") != F.coalesce("_b", "rep")).select(*rows.columns)

    def _test(self, pairs: DataFrame) -> None:
        if self.tested is not None:
            pairs = pairs.join(self.tested.select("member", "rep"), ["member", "rep"], "left_anti")
        pairs = shared_table(pairs, "dedup-pairs")
        if pairs.isEmpty():
            return
        checked = shared_table(verify(pairs, self.texts, self.threshold), "dedup-checked")
        self.tested = checked if self.tested is None else self.tested.unionByName(checked)
        if not checked.where("ok").isEmpty():
            self.labels = components(self.tested.where("ok"))

    def compare(self, found: DataFrame) -> DataFrame:
        """Test what ``discover`` found; returns (cls, band, label, apart) of each key with a row that is still apart from the representative.

        A link that is still missing has different labels at its ends, so at least one end is apart.  The representative
        was tested with all that are apart and needs no row.  First each member meets the most connected of its representatives, which connects large groups; then what that left apart.
        """
        first = self._apart(found).groupBy("cls").agg(F.max(F.struct("degree", "rep")).alias("r"))
        self._test(first.select(F.col("cls").alias("member"), "r.rep"))
        self._test(self._apart(found).select(F.col("cls").alias("member"), "rep").distinct())
        if self.labels is None:
            return shared_table(found.select("cls", "band", F.col("cls").alias("label"), F.lit(True).alias("apart")), "dedup-rows")
        open_ = shared_table(self._apart(found).select("cls", "band"), "dedup-apart")
        keys = shared_table(open_.select("band").distinct(), "dedup-open-keys")
        rows = found.select("cls", "band").join(keys, "band")
        rows = rows.join(open_.withColumn("apart", F.lit(True)), ["cls", "band"], "left").join(self.labels, "cls", "left")
        return shared_table(rows.select("cls", "band", F.coalesce("label", "cls").alias("label"), F.coalesce("apart", F.lit(False)).alias("apart")), "dedup-rows")

    def finish(self, rows: DataFrame) -> DataFrame | None:
        """Compare what stars left apart, as ``compare`` returns it, block by block; returns the labels."""
        more = shared_table(blockwise(rows, self.texts, self.threshold), "dedup-more")
        if more.isEmpty():
            return self.labels
        return components(more if self.tested is None else self.tested.where("ok").select("member", "rep").unionByName(more))


def blockwise(rows: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """All links (member, rep) within each band of (cls, band, label) between different labels, compared in blocks.

    A band's members are dealt into chunks of about ``BLOCK``; each pair of chunks is one group of a task, which compares
    its members and emits only the links.  A pair that shares several bands is compared in the first of them.  If ``rows``
    has a column ``apart``, members without it are only compared with those that have it.
    """
    if "apart" not in rows.columns:
        rows = rows.withColumn("apart", F.lit(True))
    bands_of = rows.groupBy("cls").agg(F.array_sort(F.collect_set("band")).alias("own"))
    sizes = shared_table(rows.groupBy("band").agg(F.count("*").alias("n"), F.count_if("apart").alias("a")).where("n > 1 and a > 0"), "dedup-sizes")
    # chunks from 0 hold the apart and meet all chunks, those after them hold the others and meet the apart only
    first, rest = F.ceil(F.col("a") / BLOCK), F.ceil((F.col("n") - F.col("a")) / BLOCK)
    dealt = rows.join(sizes, "band").withColumn("m", first).withColumn("r", rest)
    own = F.xxhash64("cls", F.lit(1))
    dealt = dealt.withColumn("c", F.when(F.col("apart"), F.pmod(own, F.col("m"))).otherwise(F.col("m") + F.pmod(own, F.greatest("r", F.lit(1)))))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1 + F.when(F.col("apart"), F.col("r")).otherwise(F.lit(0))))
    dealt = dealt.select("cls", "label", "band", "c", other.alias("o")).select("cls", "label", "band", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c")
    full = dealt.join(bands_of, "cls").join(texts, "cls").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "c", "cls")
    target = pa.schema([("member", pa.int64()), ("rep", pa.int64())])

    def linked(band, i, j, old: list, new: list) -> Iterator[tuple[int, int]]:
        """Links between members (chunk, cls, label, bands, words, labelled words) held and those that came after them."""
        if not old or not new:
            return
        size, size2 = np.array([len(m[4]) for m in old]), np.array([len(m[4]) for m in new])
        reach = overlaps([m[5] for m in old], [m[5] for m in new]) >= needed(size[:, None], size2[None, :], threshold)
        for x, y in zip(*np.nonzero(reach)):
            (chunk, cls, label, own, words, _), (chunk2, cls2, label2, own2, words2, _) = old[x], new[y]
            if label == label2 or i != j and chunk == chunk2 or cls >= cls2 and i == j or min(own.intersection(own2)) != band:
                continue
            if similarity(words, words2, threshold) >= threshold - 1e-9:
                yield cls, cls2

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in it for lo in range(0, batch.num_rows, 64) for r in zip(*(c.to_pylist() for c in batch.slice(lo, 64).columns)))
        for (band, i, j), group in itertools.groupby(rows, key=lambda r: r[:3]):
            held, out = [], []
            while some := list(itertools.islice(group, 64)):
                new = []
                for _, _, _, chunk, cls, label, own, data in some:
                    words = np.frombuffer(data, np.uint32)
                    new.append((chunk, cls, label, set(own), words, labelled(words)))
                if i == j:
                    held += new
                    out += linked(band, i, j, held, new)
                else:  # the other chunk's members come after and only meet these
                    held += [m for m in new if m[0] == i]
                    out += linked(band, i, j, held, [m for m in new if m[0] != i])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), target)], schema=target)

    return full.select("band", "i", "j", "c", "cls", "label", "own", "words").mapInArrow(run, "member bigint, rep bigint")


def links(unique: DataFrame, sketched: DataFrame, threshold: float) -> DataFrame | None:
    """(cls, label) of the connected different texts; None if there are none."""
    found = discover(unique.select("cls", "least", F.explode("bands").alias("band")))
    some = found.select("cls").union(found.select("rep"))
    # only texts that share a key with another are ever compared; a class's words are those of its least document
    some = some.distinct().join(unique, "cls").select("cls", F.col("words_key").alias("_k"), "least")
    same = (F.col("words_key") == F.col("_k")) & F.col("doc").eqNullSafe(F.col("least"))
    texts = shared_table(sketched.select("doc", "words_key", "words").join(some, same).select("cls", "words").dropDuplicates(["cls"]), "dedup-texts")
    linker = _Linker(texts, threshold)
    return linker.finish(linker.compare(found))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row with text: doc, text_key, words_key, dup_class (least document of the class), class_texts (different texts in it), kept.

    ``kept`` marks one (doc, text_key) of each class: the least doc, null last, then the least words_key, then the least text_key.
    """
    sketched = shared_table(sketches(docs, key, text), "dedup-sketches")
    row = F.struct(F.col("doc").isNull().alias("none"), "doc", "text_key")
    unique = sketched.groupBy("words_key").agg(F.min(row).alias("r"), F.any_value("bands").alias("bands"))
    # numbers of the written table: unlike hashes they never collide, and they are read, not computed, from here on
    unique = shared_table(unique.select("words_key", F.col("r.doc").alias("least"), F.col("r.text_key").alias("least_text"), "bands", F.monotonically_increasing_id().alias("cls")), "dedup-unique")
    connected = links(unique, sketched, threshold)
    named = unique.select("words_key", "cls", "least", "least_text")
    if connected is None:
        labels = named.select("words_key", F.col("least").alias("dup_class"), F.lit(1).cast("bigint").alias("class_texts"), F.lit(True).alias("first"), "least_text")
    else:
        order = F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("doc"), "words_key")
        whole = shared_table(named.join(connected, "cls").groupBy("label").agg(F.min(order).alias("h"), F.count("*").alias("class_texts")), "dedup-classes")
        joined = named.join(connected, "cls", "left").join(whole, "label", "left")
        alone = F.col("h").isNull()
        labels = joined.select("words_key", F.when(alone, F.col("least")).otherwise(F.col("h.doc")).alias("dup_class"), F.coalesce("class_texts", F.lit(1)).alias("class_texts"), (alone | (F.col("words_key") == F.col("h.words_key"))).alias("first"), "least_text")
    kept = F.col("first") & F.col("doc").eqNullSafe(F.col("dup_class")) & (F.col("text_key") == F.col("least_text"))
    return sketched.select("doc", "text_key", "words_key").join(labels, "words_key").select("doc", "text_key", "words_key", "dup_class", "class_texts", kept.alias("kept"))
