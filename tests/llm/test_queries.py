"""Every registered query of the training-data operators over the smallest tables, against plain Python."""
import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from medlattice.llm import audio, fingerprint, langid
from medlattice.llm.queries import TOKENIZER
from tests.llm.test_models import brute_base, brute_classes, brute_links

SF = "/root/testdata/sf0.001"


def crc(i, modulus):
    return zlib.crc32(str(i).encode()) % modulus


def run(spark, name):
    return [r.asDict() for r in entry.queries()[name](spark, SF).collect()]


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.no_truncation()
    t.no_padding()
    return t


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


# --- language mixtures by plain loops


def brute_mixture(model, text, rounds=8):
    """(language, score, {language: share}) of a text: words, their likelihoods, expectation-maximisation, nested sets."""
    letters = [c if c.isalpha() else None for c in (text or "").lower()]
    words, run = [], []
    for i, c in enumerate([*letters, None]):
        if c is None:
            words += [run] if run else []
            run = []
            continue
        code = [ord(x) if x else 0 for x in (letters[i - 1] if i else None, c, letters[i + 1] if i + 1 < len(letters) else None)]
        h = (code[0] * 0x9E3779B1 + code[1] * 0x85EBCA77 + code[2] * 0xC2B2AE3D) % 2**32
        h ^= h >> 15
        run.append(h * 0x2C1B3C6D % 2**32 >> 16)
    n = len(model.langs)
    if not words or not n:
        return "und", 0.0, {}
    ll = [[sum(float(model.logp[k][b]) for b in w) for k in range(n)] for w in words]
    best = [max(x) for x in ll]

    def fit(own):
        theta = {k: 1 / len(own) for k in own}
        for _ in range(rounds):
            total = dict.fromkeys(own, 0.0)
            for x, top in zip(ll, best):
                r = {k: theta[k] * math.exp(x[k] - top) for k in own}
                z = max(sum(r.values()), 1e-30)
                for k in own:
                    total[k] += r[k] / z
            theta = {k: total[k] / len(words) for k in own}
        value = sum(top + math.log(max(1e-30, sum(theta[k] * math.exp(x[k] - top) for k in own))) for x, top in zip(ll, best))
        return theta, value

    theta, full = fit(range(n))
    order = sorted(range(n), key=lambda k: -(theta[k] + 1e-9 * math.exp(model.prior[k])))
    cost, value, chosen = 0.5 * math.log(max(2, len(words))), -math.inf, {}
    for k in range(1, n + 1):
        own = order[:k]
        mix, fitted = ({own[0]: 1.0}, sum(x[own[0]] for x in ll)) if k == 1 else (theta, full) if k == n else fit(own)
        if fitted - cost * (k - 1) > value + 1e-9:
            value, chosen = fitted - cost * (k - 1), mix
    top = max(chosen, key=lambda k: chosen[k] + 1e-9 * math.exp(model.prior[k]))
    return model.langs[top], min(1.0, chosen[top]), {model.langs[k]: v for k, v in chosen.items() if v > 0}


def test_op1(spark, docs):
    got = {r["doc_id"]: r for r in run(spark, "op1_langid")}
    assert len(got) == len(docs)
    learnt = spark.createDataFrame([d for d in docs if crc(d[0], 4) != 2], "doc_id bigint, text string, lang string, source string")
    model = langid.train(learnt)
    right = []
    for i, text, lang, _ in docs:
        r = got[i]
        assert r["held_out"] == (crc(i, 4) == 2) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
        if len(text or "") < 3000:
            want = brute_mixture(model, text)
            assert r["lang_pred"] == want[0] and abs(r["score"] - want[1]) < 2e-3
            assert all(abs(dict(zip(r["langs"], r["proportions"])).get(k, 0.0) - v) < 2e-3 for k, v in want[2].items())
        if r["held_out"] and lang and r["lang_pred"] != "und":
            right.append(r["lang_pred"] == lang)
    assert np.mean(right) > 0.95


def test_op2(spark, docs):
    got = {r["doc_id"]: r for r in run(spark, "op2_fingerprints")}
    texts = [(i, t or "") for i, t, *_ in docs]
    assert len(got) == len(texts)
    for (i, t), (_, u) in zip(texts, texts[1:] + texts[:1]):
        edited, r = t[: len(t) - len(t) // 2] + u[: len(t) // 2], got[i]
        own, changed, other = (fingerprint.chunk_set(x) for x in (t, edited, u))
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(t), sha(edited), fingerprint.serialise(own), fingerprint.serialise(changed))
        assert (r["near_edited"], r["near_next"]) == (fingerprint.containment(own, changed), fingerprint.containment(own, other))


def test_op3(spark, docs):
    got = {r["doc_id"]: r for r in run(spark, "op3_hmm")}
    rows = [(i, crc(i, 7) == 2, t) for i, t, *_ in docs]
    for i, (n, known, total, base) in brute_base(rows).items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total) and abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
        assert math.isfinite(r["score"])
    held = [got[i] for i, h, _ in rows if h]
    assert all(r["held_out"] for r in held) and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_op4(spark):
    pages = [(r["page_id"], (r["html"] or "").encode()) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    largest, many = {}, Counter(h for _, h in pages)
    for i, h in pages:
        largest[h] = max(i, largest.get(h, i))
    got = {r["page_id"]: r for r in run(spark, "op4_warc")}
    assert len(got) == len(pages)
    for i, h in pages:
        again = len(h) >= 1000 and many[h] > 1 and largest[h] != i
        assert got[i] == {"page_id": i, "payload_bytes": len(h), "payload_digest": hashlib.sha1(h).hexdigest(), "record_type": "revisit" if again else "response", "refers_to": largest[h] if again else None}


def test_op5(spark, docs):
    got = {r["doc_id"]: r for r in run(spark, "op5_kdtree")}
    size = {i: len((t or "").encode()) + 16 for i, t, *_ in docs}
    assert {i: r["size"] for i, r in got.items()} == size and all(r["text_crc32"] == zlib.crc32((t or "").encode()) for i, t, *_ in docs for r in [got[i]])
    own: dict = {}
    for r in got.values():
        assert r["law"] == "bytes" and r["grown_shard"] is None
        own.setdefault(r["shard"], []).append(r)
    assert set(own) <= set(range(40)) and all(sorted(r["slot"] for r in rows) == list(range(len(rows))) for rows in own.values())
    assert max(sum(r["size"] for r in rows) for rows in own.values()) <= sum(size.values()) / 40 + 6 * max(size.values())


def test_op6(spark, docs, library):
    got = {r["doc_id"]: r for r in run(spark, "op6_bpe")}
    for i, t, *_ in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False)))


def test_op7(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    turns: dict = {-1: [("user", said), ("assistant", said)]}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn", "role", "text").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    got = {r["conv_id"]: r for r in run(spark, "op7_chat")}
    assert set(got) == set(turns)
    for i, rows in turns.items():
        loss = "".join(t for role, t in rows if role == "assistant")
        r = got[i]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(rows), sha("".join(f"{role}\n{t}\n" for role, t in rows)), len(loss), sha(loss))
        assert r["formatted_chars"] >= sum(len(role) + len(t) for role, t in rows)


def test_op8(spark, docs):
    got = {r["doc_id"]: r for r in run(spark, "op8_audio")}
    for i, t, *_ in docs:
        data = (t or "").encode()
        payload = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        media, r = audio.write_wav(payload), got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), sha(payload), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(media), sha(media), audio.clip_summary(media))


@pytest.fixture(scope="module")
def links(docs):
    return list(brute_links([(i, t) for i, t, *_ in docs]))


def test_op9(spark, docs, links):
    got = {r["doc_id"]: r for r in run(spark, "op9_neardup")}
    want = brute_classes([(i, t) for i, t, *_ in docs], links)
    assert set(got) == {i for i, *_ in docs}
    assert all(got[i]["class_id"] == i for i, t, *_ in docs if t is None)
    assert all(want[got[i]["class_id"]] == c for i, c in want.items())  # no two that brute force holds apart
    assert np.mean([got[i]["class_id"] == got[j]["class_id"] for i, j, _ in links]) >= 0.9


def test_op10(spark, docs):
    got = run(spark, "op10_mix")
    assert {r["doc_id"] for r in got} == {i for i, *_ in docs} and all(0 <= r["mix_at"] <= 1 for r in got)
    taken, total, source = Counter(), Counter(), {i: (s, len((t or "").split())) for i, t, _, s in docs}
    for i, (s, n) in source.items():
        total[s] += n
    for r in got:
        assert r["source"] == source[r["doc_id"]][0]
        taken[r["source"]] += source[r["doc_id"]][1]
    assert all(taken[s] >= total[s] for s in total) and len({(r["doc_id"], r["pass"]) for r in got}) == len(got)


def test_pipeline(spark, docs, links, library):
    """Letters, classes, repeats and tokens of the whole pipeline, each worked out by itself."""
    got = run(spark, "pipeline")
    texts = {i: t for i, t, *_ in docs if any(c.isalpha() for c in t or "")}
    classes = brute_classes(list(texts.items()), [x for x in links if x[0] in texts and x[1] in texts])
    kept = {r["doc_id"] for r in got}
    assert kept <= set(texts)
    linked = [x for x in links if x[0] in texts and x[1] in texts]
    assert {classes[i] for i in kept} == set(classes.values())  # every class is there, nearly always once
    assert len(kept) - len(set(classes.values())) <= 0.1 * len(linked) + 1
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()))
    assert max(Counter(r["doc_id"] for r in got).values()) <= 3


def test_stages_keep_clashing_columns(spark):
    import corpus_pipeline

    names = ["lang_pred", "score", "langs", "proportions", "_h", "_t", "_s", "_block", "pass", "mix_at", "row", "cls", "label", "band", "ids_sha256", "n_tokens", "n", "kept"]
    rows = [(i, f"word{i} and some other words of text number {i * 7}", "en" if i % 2 else "fr", "s", 0) for i in range(12)] + [(None, "an unnamed text", "en", None, 0)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumns({n: F.lit(f"own {n}") for n in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, "")
        assert out.columns == d.columns and {tuple(r[n] for n in names) for r in out.collect()} == {tuple(f"own {n}" for n in names)}
        assert {r["doc_id"] for r in out.collect()} == {r[0] for r in rows}
    assert corpus_pipeline.tokenise(spark, d, "").count() == len(rows)
