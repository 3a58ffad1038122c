"""Language id, HMM scoring, near-duplicates: accuracy, brute force and edge cases."""
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from medlattice.llm import hmm, langid, neardup
from medlattice.llm.shared import shared_table

SYLLABLES = {"en": ["the", "ing", "er", "and", "ion", "th", "ou", "ea"], "fr": ["eau", "que", "é", "ment", "oi", "les", "aux", "è"], "de": ["sch", "ung", "ein", "keit", "ich", "ü", "ge", "pf"]}


def text_of(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


def corpus(spark, n=120):
    rng = random.Random(3)
    rows = [(i, text_of(rng, lang, rng.randint(5, 60)), lang, "x") for i, lang in enumerate(rng.choices(list(SYLLABLES), k=n))]
    rows += [(n, None, "en", "x"), (n + 1, "", None, "x"), (n + 2, "12 34 !?", "en", "x"), (n + 3, rows[0][1], rows[0][2], "x"), (n + 4, text_of(rng, "en", 30) + " " + text_of(rng, "fr", 30), None, "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, langs string")


def test_language_mixture(spark):
    d = corpus(spark)
    model = langid.train(d.where("doc_id % 4 <> 2"))
    got = {r["doc_id"]: r for r in langid.predict(d.withColumnRenamed("langs", "clash"), model, ["doc_id", "lang"]).collect()}
    assert len(got) == d.count()
    held = [r for r in got.values() if r["doc_id"] % 4 == 2 and r["doc_id"] < 120]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.95
    for i in (120, 121, 122):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["langs"]) == ("und", 0.0, [])
    assert got[123]["proportions"] == got[0]["proportions"]
    mixed = dict(zip(got[124]["langs"], got[124]["proportions"]))
    assert set(mixed) == {"en", "fr"} and abs(sum(mixed.values()) - 1) < 1e-6 and 0.3 < mixed["en"] < 0.7
    empty = langid.train(d.where("lang is null"))
    assert {r["lang_pred"] for r in langid.predict(d, empty, ["doc_id"]).collect()} == {"und"}
    assert langid.predict(d.limit(0), model, ["doc_id"]).count() == 0


def test_mixture_does_not_depend_on_neighbours():
    rng = random.Random(1)
    texts = [text_of(rng, lang, 20) for lang in SYLLABLES for _ in range(5)]
    counts = np.zeros((langid.BUCKETS, 3))
    for i, lang in enumerate(sorted(SYLLABLES)):
        g, _, _ = langid.word_trigrams([text_of(rng, lang, 500)])
        counts[:, i] = np.bincount(g, minlength=langid.BUCKETS)
    m = langid.Model(sorted(SYLLABLES), counts, np.ones(3))
    together = m.predict(texts, 3, 8, 1.0)
    for t, whole in zip(texts, together):
        alone = m.predict([t], 3, 8, 1.0)[0]
        assert alone[0] == whole[0] and abs(alone[1] - whole[1]) < 1e-4


def test_more_than_three_languages(spark):
    rng = random.Random(8)
    letters = {"aa": "abcd", "bb": "efgh", "cc": "ijkl", "dd": "mnop", "ee": "qrst"}
    words = lambda lang, n: ["".join(rng.choices(letters[lang], k=6)) for _ in range(n)]
    rows = [(i, " ".join(words(lang, 50)), lang) for i, lang in enumerate(list(letters) * 20)]
    model = langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    for langs in (list(letters), list(letters)[:4]):
        text = " ".join(w for lang in langs for w in words(lang, 40))
        r = langid.predict(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), model, ["doc_id"]).first()
        assert sorted(r["langs"]) == langs and np.allclose(r["proportions"], 1 / len(langs), atol=0.02) and abs(r["score"] - 1 / len(langs)) < 0.02


# --- HMM


def test_forward_is_exact():
    rng = np.random.default_rng(0)
    s, v = 3, 5
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    m = hmm.Hmm(norm(rng.random(s), 0), norm(rng.random((s, s)), 1), norm(rng.random((v, s)), 0), np.full(s, 1 / s))
    seqs = [rng.integers(0, v, n).astype(np.uint16) for n in (1, 2, 4, 5, 3)]
    want = []
    for x in seqs:
        total = 0.0
        for path in itertools.product(range(s), repeat=len(x)):
            p = m.start[path[0]] * m.emit[x[0], path[0]]
            for t in range(1, len(x)):
                p *= m.move[path[t - 1], path[t]] * m.emit[x[t], path[t]]
            total += p
        want.append(math.log(total))
    assert np.allclose(hmm.log_likelihoods(m, seqs), want)
    # expected counts against path enumeration
    start, move, emit = hmm.expected_counts(m, seqs, [True] * len(seqs))
    s0, mv, em = np.zeros(s), np.zeros((s, s)), np.zeros((v, s))
    for x, w in zip(seqs, want):
        for path in itertools.product(range(s), repeat=len(x)):
            p = m.start[path[0]] * m.emit[x[0], path[0]]
            for t in range(1, len(x)):
                p *= m.move[path[t - 1], path[t]] * m.emit[x[t], path[t]]
            p /= math.exp(w)
            s0[path[0]] += p
            for t in range(len(x)):
                em[x[t], path[t]] += p
                if t:
                    mv[path[t - 1], path[t]] += p
    assert np.allclose(start, s0) and np.allclose(move, mv) and np.allclose(emit, em)


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(2)
    seqs = [np.concatenate((rng.integers(0, 4, 30), [8])) if i % 2 else np.concatenate((rng.integers(4, 8, 30), [8])) for i in range(60)]
    seqs = [s.astype(np.uint16) for s in seqs]
    weight = np.bincount(np.concatenate(seqs), minlength=9) / sum(map(len, seqs))
    m, last = hmm.Hmm.begin(weight, 4), -np.inf
    for _ in range(25):
        now = hmm.log_likelihoods(m, seqs).sum()
        assert now >= last - 2.0  # smoothing may cost a little
        last, m = now, hmm.Hmm.from_counts(*hmm.expected_counts(m, seqs, [True] * len(seqs)), weight)
    assert last > sum(np.log(weight[s]).sum() for s in seqs) + 100


def brute_base(rows):
    split = lambda t: (t or "").encode().lower().split() + [b""]
    counts = Counter(w for _, held, t in rows if not held for w in split(t))
    n, v = sum(counts.values()), len(counts)
    return {d: (len(split(t)), sum(w in counts for w in split(t)), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in split(t))) for d, _, t in rows}


def test_scores(spark):
    rng = random.Random(5)
    vocabulary = {lang: text_of(rng, lang, 80).split() for lang in SYLLABLES}
    rows = [(i, zlib.crc32(str(i).encode()) % 7 == 2, " ".join(rng.choices(vocabulary[("en", "fr", "de")[i % 3]], k=rng.randint(1, 120)))) for i in range(150)]
    rows += [(150, False, None), (151, True, ""), (152, False, "Ünï ÀB \x0b x\x1cy\u00a0z"), (153, False, rows[0][2]), (154, True, "w " * 3000)]
    d = spark.createDataFrame(rows, "doc_id bigint, held_out boolean, text string")
    got = {r["doc_id"]: r for r in hmm.score(d).collect()}
    for i, (n, known, total, base) in brute_base(rows).items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
        assert math.isfinite(r["score"]) and r["score"] < 0
    held = [r for r in got.values() if r["held_out"] and r["doc_id"] < 150]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    none = hmm.score(d.withColumn("held_out", F.lit(True))).collect()
    assert {(r["n_known"], r["train_tokens"], r["base_score"]) for r in none} == {(0, 0, 0.0)}
    assert hmm.score(d.limit(0)).count() == 0


def test_long_texts_are_trained_on(spark):
    rng = random.Random(9)
    vocabulary = {lang: text_of(rng, lang, 80).split() for lang in SYLLABLES}
    rows = [(i, i % 4 == 3, " ".join(rng.choices(vocabulary[("en", "fr", "de")[i % 3]], k=2600))) for i in range(12)]
    got = hmm.score(spark.createDataFrame(rows, "doc_id bigint, held_out boolean, text string")).collect()
    # the languages' states part, so a word costs much less than by the shares of all words
    assert min(r["score"] - r["base_score"] for r in got) > 0.2 * 2600


def test_pieces_count_everything_once(monkeypatch):
    """Counts in pieces with context are those of whole sequences, transitions over the cuts included."""
    monkeypatch.setattr(hmm, "PIECE", 40)
    rng = np.random.default_rng(4)
    s, v = 3, 6
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    m = hmm.Hmm(norm(rng.random(s), 0), norm(rng.random((s, s)) + np.eye(s), 1), norm(rng.random((v, s)), 0), np.full(s, 1 / s))
    seqs = [rng.integers(0, v, n).astype(np.uint16) for n in (1, 39, 40, 41, 500, 173)]
    whole, cut = hmm.expected_counts(m, seqs, [True] * len(seqs)), hmm.expected_counts(m, *hmm.pieces(seqs))
    assert abs(cut[2].sum() - sum(map(len, seqs))) < 1e-6 and abs(cut[1].sum() - sum(len(x) - 1 for x in seqs)) < 1e-6
    assert all(np.allclose(a, b, rtol=2e-3, atol=1e-2) for a, b in zip(whole, cut))


class _CountedProducts(np.ndarray):
    """A matrix that counts the products it takes part in."""

    products = 0

    def __array_ufunc__(self, ufunc, method, *args, out=None, **kwargs):
        _CountedProducts.products += ufunc is np.matmul
        plain = lambda x: x.view(np.ndarray) if isinstance(x, _CountedProducts) else x
        return getattr(ufunc, method)(*map(plain, args), **({"out": tuple(map(plain, out))} if out else {}), **kwargs)


def test_scoring_goes_once_over_the_longest_text():
    """Texts of any lengths are scored side by side, in as many steps as the longest has; the result is that of each text alone."""
    rng = np.random.default_rng(6)
    s, v = 4, 50
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    emit = norm(rng.random((v, s)) ** 40 + 1e-18, 0)  # some symbols are next to impossible
    move = norm(rng.random((s, s)) * 1e-12 + np.eye(s), 1)
    seqs = [rng.integers(0, v, n).astype(np.uint16) for n in rng.integers(1, 2500, 300)]
    _CountedProducts.products = 0
    got = hmm.log_likelihoods(hmm.Hmm(np.full(s, 1 / s), move.view(_CountedProducts), emit, np.full(s, 1 / s)), seqs)
    assert 0 < _CountedProducts.products < 1.2 * max(map(len, seqs))
    for x, ll in list(zip(seqs, got))[:20]:
        a, want = np.full(s, 1 / s), 0.0
        for t, y in enumerate(x):
            a = (a @ move if t else a) * emit[y]
            want += math.log(a.sum())
            a = a / a.sum()
        assert abs(ll - want) < 1e-9 * abs(want)


def test_classes_by_tails():
    """The class of a word is that of its last two characters, however many bytes these have."""
    words = "a ab cab éab bé xbé é 日本 x日 日x z\u0301 \U0001f600b b\U0001f600".split() * 2
    tails = hmm._Tails()
    for w in words:
        want = zlib.crc32(w[-2:].encode()) % hmm.CLASSES
        assert hmm.word_class(w.encode()) == want and tails.word_class(w.encode()) == want


def test_the_end_is_a_symbol_of_long_texts(spark):
    """Ends that are rarer than any frequent word keep a probability of their own; the model's distribution sums to one."""
    rng = random.Random(10)
    rows = [(i, False, " ".join(rng.choices("abcdefghij", k=12_000))) for i in range(4)] + [(9, True, "a"), (10, True, "")]
    got = {r["doc_id"]: r for r in hmm.score(spark.createDataFrame(rows, "doc_id bigint, held_out boolean, text string")).collect()}
    assert got[10]["n_known"] == 1 and got[10]["score"] < -3 and got[9]["score"] < -4  # an end after one word is as rare as in training
    assert got[0]["score"] > got[0]["base_score"] - 20


# --- near-duplicates


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def brute_links(docs):
    """All pairs by the similarity of the module's contract, worked out with plain lists: word similarity by pair, and that of five-word shingles."""
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or [tuple(w)]
    items = [(i, t.lower().split()) for i, t in docs if t is not None]
    for (i, a), (j, b) in itertools.combinations(items, 2):
        if (Counter(a) & Counter(b)).total() >= 0.8 * (len(a) + len(b)) / 1.8 - 1e-9:
            s, g, h = lcs(a, b), grams(a), grams(b)
            if not a and not b or s / (len(a) + len(b) - s) >= 0.8 - 1e-9:
                m = lcs(g, h)
                yield i, j, m / (len(g) + len(h) - m)


def brute_classes(docs, links):
    parent = {i: i for i, t in docs if t is not None}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j, *_ in links:
        x, y = sorted((find(i), find(j)))
        parent[y] = x
    return {i: find(i) for i in parent}


def edit(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"neu{rng.randrange(10**6)}"
    return words


def families(rng):
    passage = [f"p{i}" for i in range(40)]
    docs, i = [], 0
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(30, 250))]
        for k in range(8):
            docs.append((i, " ".join(edit(rng, base, k % 5))))
            i += 1
    for _ in range(40):  # texts that share but a passage
        docs.append((i, " ".join(passage + [f"u{rng.randrange(10**6)}" for _ in range(rng.randint(20, 60))])))
        i += 1
    docs += [(i, "A b c"), (i + 1, "a  B c"), (i + 2, ""), (i + 3, " "), (i + 4, None), (i + 5, None), (i + 6, docs[0][1]), (i + 6, docs[0][1])]
    docs += [(i + 7, " ".join(["la"] * 300)), (i + 8, " ".join(["la"] * 290))]
    return docs


def test_near_duplicates_against_all_pairs(spark):
    """No link that brute force has not, every link of 0.8 by shingles, and nine of ten of all links."""
    docs = families(random.Random(11))
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("doc", F.lit(1)).withColumn("cls", F.lit(2)).withColumn("band", F.lit("x"))
    pairs = list(brute_links(docs))
    want = brute_classes(docs, pairs)
    got = {r["doc"]: r["dup_class"] for r in neardup.classes(d).collect()}
    assert set(got) == set(want) and all(want[c] == want[i] for i, c in got.items())
    assert all(got[i] == got[j] for i, j, shingle in pairs if shingle >= 0.8)
    assert np.mean([got[i] == got[j] for i, j, _ in pairs]) >= 0.9
    assert neardup.classes(d.limit(0)).count() == 0
    alone = neardup.classes(spark.createDataFrame([(3, "x y z")], "doc_id bigint, text string")).collect()
    assert [(r["doc"], r["dup_class"], r["class_texts"]) for r in alone] == [(3, 3, 1)]


def test_recall_of_planted_copies(spark):
    """Copies with 2 to 7 % of their words replaced, lost or added, found with their original; texts that share half a page are not."""
    rng = random.Random(31)
    passage = [f"p{i}" for i in range(50)]
    docs, copies, clean = [], [], []
    for _ in range(40):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(80, 400))]
        docs.append((len(docs), " ".join(base)))
        for _ in range(4):
            out, rate = [], rng.uniform(0.02, 0.07)
            for w in base:
                x = rng.random() / rate
                out += [] if x < 0.2 else [w, f"n{rng.randrange(10**6)}"] if x < 0.4 else [f"n{rng.randrange(10**6)}"] if x < 1 else [w]
            copies.append((len(docs), docs[-1 - len(copies) % 4][0]))
            docs.append((len(docs), " ".join(out)))
    for _ in range(60):
        clean.append(len(docs))
        docs.append((len(docs), " ".join(passage + [f"u{rng.randrange(10**6)}" for _ in range(rng.randint(30, 60))])))
    got = {r["doc"]: r["dup_class"] for r in neardup.classes(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert np.mean([got[i] == got[j] for i, j in copies]) >= 0.95
    assert all(got[i] == i for i in clean)


def test_blocks_find_every_link(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    docs = [(i, edit(rng, base, rng.randint(0, 14))) for i in range(40)]
    texts = spark.createDataFrame([(i, bytearray(neardup.word_hashes(w).tobytes())) for i, w in docs], "cls bigint, words binary")
    rows = spark.createDataFrame([(i, b, i % 20) for i, _ in docs for b in (7, 9)], "cls bigint, band bigint, label bigint")
    want = set()
    for (i, a), (j, b) in itertools.combinations(docs, 2):
        s = lcs(a, b)
        if i % 20 != j % 20 and s / (len(a) + len(b) - s) >= 0.8 - 1e-9:
            want.add((i, j))
    for block in (256, 7):
        old, neardup.BLOCK = neardup.BLOCK, block
        try:
            got = [tuple(sorted((r["member"], r["rep"]))) for r in neardup.blockwise(rows, shared_table(texts, "t"), 0.8).collect()]
        finally:
            neardup.BLOCK = old
        assert len(got) == len(set(got)) and set(got) == want and 0 < len(want) < 700


def test_overlaps_bound_the_matches():
    rng = random.Random(6)
    seqs = [np.array([rng.randrange(30) for _ in range(rng.randint(0, 50))], np.uint32) for _ in range(20)]
    got = neardup.overlaps([neardup.labelled(s) for s in seqs], [neardup.labelled(s) for s in seqs])
    for i, a in enumerate(seqs):
        for j, b in enumerate(seqs):
            assert got[i, j] == (Counter(a.tolist()) & Counter(b.tolist())).total() >= lcs(a.tolist(), b.tolist())


def members(spark, docs, keys):
    """Runs the comparison of (cls, words), where keys maps a band to its members and its representative; returns the labels."""
    texts = spark.createDataFrame([(i, bytearray(neardup.word_hashes(w).tobytes())) for i, w in docs], "cls bigint, words binary")
    found = spark.createDataFrame([(i, i, band, rep, degree) for band, (own, rep, degree) in keys.items() for i in own if i != rep], "cls bigint, least bigint, band bigint, rep bigint, degree bigint")
    linker = neardup._Linker(shared_table(texts, "t"), 0.8)
    labels = linker.finish(linker.compare(shared_table(found, "f")))
    return {r["cls"]: r["label"] for r in labels.collect()}


@pytest.mark.parametrize("block", (256, 2))
def test_links_of_members_connected_to_the_representative(spark, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    base = [f"w{i}" for i in range(120)]
    changed = lambda *at: [f"x{i}" if any(a <= i < a + 6 for a in at) else w for i, w in enumerate(base)]
    # a chain: 1 - 2 and 2 - 3 are linked, 1 - 3 is not; 1 stands for the key
    chain = [(1, changed(20, 40)), (2, changed()), (3, changed(60, 80))]
    assert members(spark, chain, {7: ([1, 2, 3], 1, 9)}) == {1: 1, 2: 1, 3: 1}
    # two families, connected by a bridge between members alone; 1 and 11 stand for the keys that the families have
    other = lambda *at: [f"y{i}" if any(a <= i < a + 6 for a in at) else w for i, w in enumerate(changed(60, 80))]
    families = [*chain[:1], (2, changed()), (4, changed(20)), (5, changed(40)), (11, other(0, 100)), (12, other()), (14, other(0)), (15, other(100))]
    keys = {7: ([1, 2, 4, 5, 11, 12, 14, 15], 1, 9), 8: ([11, 12, 14, 15], 11, 8)}
    assert set(members(spark, families, keys).values()) == {1}


@pytest.mark.parametrize("seed", range(5))
def test_alignment_against_the_table(seed):
    rng = random.Random(seed)
    a = [rng.randrange(9) for _ in range(rng.randint(0, 60))]
    b = [x for x in a if rng.random() > 0.1] + [rng.randrange(9) for _ in range(rng.randint(0, 5))]
    row = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for band in (3, 10, 100):
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                row[i + 1][j + 1] = row[i][j] + 1 if x == y and abs(i - j) <= band else max(row[i][j + 1], row[i + 1][j])
        got = neardup.aligned(np.array(a, np.uint64), np.array(b, np.uint64), band)
        # taking equal ends first never loses a match of the unbanded table, and the band holds for the rest
        assert got >= row[-1][-1] if a and b else got == 0
        if band == 100:
            assert got == row[-1][-1]
