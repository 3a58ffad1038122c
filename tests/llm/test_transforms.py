"""Fingerprints, WARC, shards, BPE, chat, audio, mixing: round trips, brute force and edge cases."""
import hashlib
import itertools
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from medlattice.llm import audio, bpe, chat, fingerprint, mixing, shard, warc
from medlattice.llm.queries import TOKENIZER

# --- fingerprints


def test_chunks_cover_and_resist_shifts():
    rng = random.Random(1)
    for n in (0, 1, 15, 16, 17, 300, 5000):
        data = bytes(rng.randrange(256) for _ in range(n))
        ends = fingerprint.cuts(data)
        assert ends == sorted(set(ends)) and (ends[-1] == n if n else ends == [])
        sizes = np.diff([0, *ends])
        assert all(s <= fingerprint.MAX for s in sizes) and all(s >= fingerprint.MIN for s in sizes[:-1])
    assert fingerprint.cuts(b"a" * 2000)[-1] == 2000
    t = " ".join(f"w{rng.randrange(10**6)}" for _ in range(600))
    a, b = fingerprint.chunk_set(t), fingerprint.chunk_set("shifted by some " + t)
    assert fingerprint.containment(a, b) > 0.9
    assert fingerprint.parse(fingerprint.serialise(a)) == a
    assert fingerprint.containment({}, {}) == 1.0 and fingerprint.containment({}, a) == 0.0
    old = fingerprint._SEGMENT
    try:
        fingerprint._SEGMENT = 100
        assert fingerprint.chunk_set(t) == a
    finally:
        fingerprint._SEGMENT = old


def test_edited_pairs_against_a_loop(spark):
    rng = random.Random(2)
    rows = [(i * 3, "".join(rng.choices("abé😀 \n", k=rng.randint(0, 400)))) for i in range(60)] + [(200, None), (201, ""), (300, "same"), (301, "same")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    for per in (4096, 3):
        got = {r["doc_id"]: r for r in d.transform(lambda x: _pairs(x, per)).collect()}
        assert len(got) == len(rows)
        for (k, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
            t, nxt = t or "", nxt or ""
            edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
            assert got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[k]["n_chars"] == len(t)
            assert got[k]["fingerprint"] == fingerprint.serialise(fingerprint.chunk_set(t))
            assert got[k]["near_next"] == fingerprint.containment(fingerprint.chunk_set(t), fingerprint.chunk_set(nxt))
    hot = [(None if i % 3 else 7, f"text {i} " * rng.randint(0, 9)) for i in range(300)] + [(i, f"own {i}") for i in range(100, 130)]
    order = {r["t"]: r["h"] for r in spark.createDataFrame(hot, "k bigint, t string").select("t", F.xxhash64("t").alias("h")).collect()}
    hot.sort(key=lambda r: (r[0] is not None, r[0] or 0, order[r[1]]))
    texts = Counter((k, hashlib.sha256((t[: len(t) - len(t) // 2] + u[: len(t) // 2]).encode()).hexdigest()) for (k, t), (_, u) in zip(hot, hot[1:] + hot[:1]))
    for per in (4096, 4):
        ranged = spark.createDataFrame(hot, "doc_id bigint, text string").repartition(4)
        assert Counter((r["doc_id"], r["edited_sha256"]) for r in _pairs(ranged, per).collect()) == texts
    assert fingerprint.with_next(ranged, "doc_id", "text", 4).where("spare = 0").groupBy("b").count().agg(F.max("count")).first()[0] < 60  # keys that many rows share are split
    twice = spark.createDataFrame([(1, "a" * 50), (1, "a" * 50), (None, "b" * 50)], "doc_id bigint, text string")
    assert fingerprint.edited_pairs(twice).count() == 3
    assert fingerprint.edited_pairs(d.limit(0)).count() == 0
    clash = fingerprint.fingerprints(d.withColumn("fingerprint", F.lit("mine")), ["doc_id", "fingerprint"])
    assert clash.columns == ["doc_id", "fingerprint", "fingerprint_", "n_chunks"] and {r["fingerprint"] for r in clash.collect()} == {"mine"} and clash.count() == len(rows)


def _pairs(d, per):
    old = fingerprint.with_next
    fingerprint.with_next = lambda *a: old(*a, rows_per_bucket=per)
    try:
        return fingerprint.edited_pairs(d)
    finally:
        fingerprint.with_next = old


# --- WARC


@pytest.mark.parametrize("seed", range(40))
def test_salvage_recovers_undamaged_records(seed):
    rng = random.Random(seed)
    packed = rng.random() < 0.5
    records = [warc.build_record(i, f"http://x/{i}\n", bytes(rng.randrange(256) for _ in range(rng.choice([0, 5, 300, 3000]))), None if rng.random() < 0.7 else 7, packed) for i in range(rng.randint(0, 8))]
    data, at, bad = bytearray(b"".join(records)), 0, set()
    places = []
    for r in records:
        places.append((at, at + len(r)))
        at += len(r)
    for _ in range(rng.choice([0, 1, 2, 3])):
        if data:
            p = rng.randrange(len(data))
            data[p] ^= 1 << rng.randrange(8)
            bad |= {i for i, (a, b) in enumerate(places) if a <= p < b}
    if data and rng.random() < 0.3:
        bad |= {i for i, (a, b) in enumerate(places) if b > len(data) - 20}
        del data[-20:]
    data, step = bytes(data), rng.choice([1 << 20, 100, 37, 1])
    got = list(warc.salvage(data[i : i + step] for i in range(0, len(data), step)))
    end = 0
    for _, offset, length, _ in got:
        assert offset == end
        end += length
    assert end == len(data)
    found = {f.get("warc-record-id") for kind, *_, f in got if kind == "record"}
    assert {f"<urn:page:{i}>" for i in range(len(records)) if i not in bad} <= found


@pytest.mark.parametrize("packed", [False, True])
def test_salvage_is_linear(packed):
    """Twice the bytes, about twice the time, whole or in pieces, with and without damage; a search takes far below the square."""
    def seconds(n, step):
        data = bytearray(b"".join(warc.build_record(i, "u", bytes([i % 251]) * 2000 + str(i).encode(), None, packed) for i in range(n)))
        data[len(data) // 2] ^= 1
        begun, got = time.perf_counter(), 0
        for kind, *_ in warc.salvage([bytes(data[i : i + step]) for i in range(0, len(data), step)]):
            got += kind == "record"
        assert got >= n - 2
        return time.perf_counter() - begun

    n = 5000 if not packed else 8000
    for step in (1 << 30, 1 << 16):
        small = min(seconds(n // 2, step) for _ in range(2))
        assert seconds(n, step) < 3.5 * small + 0.3


def test_long_candidates_are_gaps():
    good = warc.build_record(1, "u", b"x" * 300, None, False)
    claim = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: a\r\nWARC-Date: b\r\nContent-Length: 99999999999999\r\n\r\n"
    got = list(warc.salvage([claim + b"y" * 500 + good, good]))
    assert [g[0] for g in got] == ["gap", "record", "record"] and got[0][2] == len(claim) + 500
    header = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: a\r\nWARC-Date: b\r\nX: " + b"z" * 200_000 + b"\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert [g[:3] for g in warc.salvage([header[:7], header[7:100_000], header[100_000:], good])] == [("record", 0, len(header)), ("record", len(header), len(good))]
    assert [g[0] for g in warc.salvage([header[:60_000], header[60_000:], good], most=50_000)] == ["gap", "record"]
    bomb = warc.build_record(2, "u", b"0" * 3_000_000, None)
    assert [g[0] for g in warc.salvage([bomb, good], most=1 << 20)] == ["gap", "record"]


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "u", big), (2, "u", big), (5, None, big), (3, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", ""), (8, "http://a b\r\nX: y", "z" * 2000), (8, "q", "z" * 2000)]
    p = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit(1))
    marked = warc.mark_revisits(p)
    for compress, options in ((True, {}), (False, {"archive_bytes": 3000, "segment_bytes": 700})):
        segments = warc.write_archives(marked, compress, **options)
        got = warc.read_archives(segments).collect()
        assert all(r["kind"] == "record" for r in got) and len(got) == len(rows)
        refs = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["refers_to"])
        assert refs == [(1, "revisit", 5), (2, "revisit", 5)]
        for r in got:
            want = next(h or "" for i, _, h in rows if i == r["page_id"]).encode()
            assert r["payload_bytes"] == len(want) and r["payload_digest"] == hashlib.sha1(want).hexdigest()
            if r["record_type"] == "response":
                assert bytes(r["payload"]) == want
    warc.write_files(warc.write_archives(marked), str(tmp_path / "out"))
    for block in (1 << 23, 100):
        assert warc.read_archives(warc.read_files(spark, str(tmp_path / "out"), block)).where("kind = 'record'").count() == len(rows)
    assert warc.read_archives(warc.write_archives(warc.mark_revisits(p.limit(0)))).count() == 0
    junk = spark.createDataFrame([("a", 0, bytearray(b"no archive at all"))], "archive string, seq bigint, data binary")
    assert [(r["kind"], r["length"]) for r in warc.read_archives(junk).collect()] == [("gap", 17)]


# --- shards


def brute_tree(rows, leaves, first=0):
    """shard of each row (number, size, positions, tie), by plain recursion over sorted lists."""
    if leaves == 1 or not rows:
        return {r[0]: first for r in rows}
    dim = max(range(4), key=lambda d: (max(r[2][d] for r in rows) - min(r[2][d] for r in rows), -d))
    at = lambda r: (r[2][dim], r[3])
    need, done, cut = sum(r[1] for r in rows) * (leaves // 2) / leaves, 0, None
    for place, group in itertools.groupby(sorted(rows, key=at), key=at):
        w = sum(r[1] for r in group)
        if done + w >= need:
            cut = (*place, 1) if need - done > w / 2 else (*place, 0)  # the last place goes to the side that needs it more
            break
        done += w
    left = [r for r in rows if (*at(r), 0.5) < cut]
    right = [r for r in rows if (*at(r), 0.5) >= cut]
    return brute_tree(left, leaves // 2, first) | brute_tree(right, leaves - leaves // 2, first + leaves // 2)


def test_shards(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randint(0, 300), rng.choice(["en", "fr", None]), "hot" if i % 3 else f"common_{i % 7}") for i in range(3000)]
    rows += [(5000, None, None, None), (5001, "é" * 10, "en", "hot"), (0, "dup", "en", "hot"), (0, "dup", "en", "hot"), (None, "y" * 20000, "en", "hot")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumn("size", F.lit("clash")).withColumn("node", F.lit("clash"))
    slim = [(i, r["size"], [r[f"p{k}"] for k in range(4)], r["tie"], (r["doc_id"], r["size"], r["text_crc32"])) for i, r in enumerate(shard.positions(d).collect())]
    for shards in (40, 7, 1):
        got = shard.kd_shards(d, shards).collect()
        want = brute_tree(slim, shards)
        assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in got) == Counter((*r[4], want[r[0]]) for r in slim)
        for s in range(shards):
            slots = sorted(r["slot"] for r in got if r["shard"] == s)
            assert slots == list(range(len(slots)))
    size = Counter()
    for r in shard.kd_shards(d.where("doc_id is not null"), 40).collect():
        size[r["shard"]] += r["size"]
    assert set(size) == set(range(40)) and max(size.values()) - min(size.values()) <= 2 * 316
    assert len({r["shard"] for r in shard.kd_shards(d, target_bytes=50_000).collect()}) == round(sum(r[1] for r in slim) / 50_000)
    by = {r["doc_id"]: r for r in got}
    assert by[5000]["size"] == 16 and by[5000]["text_crc32"] == 0 and by[5001]["size"] == 36 and by[5001]["text_crc32"] == zlib.crc32(("é" * 10).encode())
    same = spark.createDataFrame([(1, "abc", "en", "s")] * 50, "doc_id bigint, text string, lang string, source string")
    assert shard.kd_shards(same, 4).count() == 50
    assert shard.kd_shards(same.limit(0), 4).count() == 0 and shard.kd_shards(same.limit(1), 1).count() == 1


def test_slots_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(shard, "_ROWS_PER_BUCKET", 7)
    d = spark.createDataFrame([(i // 3, "x" * (i % 50), "en", "s") for i in range(600)], "doc_id bigint, text string, lang string, source string")
    few = shard.kd_shards(d, 4).collect()
    for s in range(4):
        slots = sorted(r["slot"] for r in few if r["shard"] == s)
        assert len(slots) > 100 and slots == list(range(len(slots)))


@pytest.mark.parametrize("bounds", [512, 5])
def test_ranks_of_whole_strings(spark, bounds, monkeypatch):
    monkeypatch.setattr(shard, "_BOUNDS", bounds)
    rng = random.Random(5)
    own = {(k, f"https://example.org/{'x' * rng.randrange(30)}{rng.randrange(90)}") for k in (0, 1) for _ in range(80)}
    got = shard.string_ranks(spark.createDataFrame([*own, *own, (0, None)], "dim int, value string")).collect()
    for k in (0, 1):
        values = sorted(v for d, v in own if d == k)
        assert sorted((r["rank"], r["value"], r["n"]) for r in got if r["dim"] == k) == [(i + 1, v, len(values)) for i, v in enumerate(values)]


# --- BPE

POOL = "abcdefgh ABC'stredvḿ̀éÉΣİßǅ각가한中文0123٣²½!?<|>\n\t\x1c\x85\u00a0\u200b😀👩‍का_-…''\"﻿�"


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.no_truncation()
    t.no_padding()
    with open(TOKENIZER, encoding="utf-8") as f:
        return bpe.Tokenizer(f.read()), t


def agree(both, text):
    own, lib = both
    ids = np.frombuffer(own.packed(text), "<u4").tolist()
    want = lib.encode(text, add_special_tokens=False).ids
    assert ids == want, text[:80]
    assert "".join(own.decoded(ids)) == lib.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("seed", range(8))
def test_bpe_equals_the_library(both, seed):
    rng = random.Random(seed)
    for _ in range(200):
        t = "".join(rng.choice(POOL) for _ in range(rng.randint(0, 60)))
        agree(both, t + rng.choice(["", "", "<|endoftext|>", "<|startoftext|>x", "it's we'll'd!!'s"]) + t)


@pytest.mark.parametrize("block,piece", [(64, 200), (16, 64), (2048, 1 << 16)])
def test_streaming_needs_no_whole_text(both, block, piece, monkeypatch):
    monkeypatch.setattr(bpe, "_BLOCK", block)
    monkeypatch.setattr(bpe, "_PIECE", piece)
    monkeypatch.setattr(bpe, "_STRIDE", max(1, block // 16))
    rng = random.Random(block)
    for _ in range(40):
        n = rng.randint(300, 3000)
        agree(both, "".join(rng.choice(rng.choice(["abcdefghinrst", POOL, "!?.|'-~", "中文é"])) for _ in range(n)))
        agree(both, rng.choice(["a", "ha", "!", "中", "é", "😀", "<|endoftext|>", "'s"]) * n + rng.choice(["", " x", "s"]))


def test_stream_keeps_little(both, monkeypatch):
    tok = both[0]
    stream = bpe.WordStream(tok)
    most = 0
    for _ in range(200):
        stream.feed("abcabcde" * 64)
        most = max(most, len(stream.held))
    assert most <= tok.ahead + 2 * bpe._STRIDE


def test_short_texts_go_through_the_streams(both, monkeypatch):
    """Every word is merged by the stream and every token's text leaves the machine; long words leave in parts."""
    tok, lib = both
    fed, emitted, decoded = [], [], []
    feed, stable, machine = bpe.WordStream.feed, bpe.WordStream._stable, bpe.Utf8Machine.feed
    monkeypatch.setattr(bpe.WordStream, "feed", lambda self, t: fed.append(t) or feed(self, t))
    monkeypatch.setattr(bpe.WordStream, "_stable", lambda self: emitted.append(out := stable(self)) or out)
    monkeypatch.setattr(bpe.Utf8Machine, "feed", lambda self, d: decoded.append(d) or machine(self, d))
    tok.cache.clear()
    agree(both, "Some plain, short words")
    assert fed == ["some", "plain", ",", "short", "words"] and b"".join(decoded).count(b" ") == len(lib.encode("Some plain, short words", add_special_tokens=False).ids) - 1
    agree(both, "abcde" * 80)
    assert sum(map(len, emitted)) > 0


def test_lookahead():
    # a b | c d | then bc binds first: 'ab' hangs on c only if d does not take it before
    length = dict.fromkeys(range(4), 1)
    assert bpe.lookahead([(2, 3, 4), (1, 2, 5), (0, 1, 6)], length) == 2 or length[4] == 2
    with pytest.raises(ValueError):
        bpe.lookahead([(0, 9, 4)], dict.fromkeys(range(4), 1))


def test_utf8_machine():
    rng = random.Random(0)
    for _ in range(500):
        data = bytes(rng.choice([0x41, 0xC3, 0xA9, 0xE4, 0xB8, 0xAD, 0xF0, 0x9F, 0x98, 0x80, 0xFF, 0xC0, 0xED, 0xA0]) for _ in range(rng.randint(0, 12)))
        m, out, at = bpe.Utf8Machine(), "", 0
        while at < len(data):
            n = rng.randint(1, 3)
            out += m.feed(data[at : at + n])
            at += n
        assert out + m.finish() == data.decode("utf-8", "replace")


def test_bpe_query(spark, both):
    d = spark.createDataFrame([(1, "Hello hello"), (1, "Hello hello"), (2, None), (3, ""), (4, "x" * 70000)], "doc_id bigint, text string").withColumn("ids", F.lit(0))
    got = bpe.encode(d, TOKENIZER, ["doc_id"]).collect()
    assert len(got) == 5 and {r["n_tokens"] for r in got if r["doc_id"] in (2, 3)} == {0}
    assert next(r for r in got if r["doc_id"] == 4)["ids"] == both[1].encode("x" * 70000, add_special_tokens=False).ids
    assert bpe.encode(d.limit(0), TOKENIZER, ["doc_id"]).count() == 0
    clash = bpe.encode(d, TOKENIZER, ["doc_id", "ids"])
    assert clash.columns == ["doc_id", "ids", "ids_", "n_tokens", "ids_sha256", "decoded_sha256"] and {r["ids"] for r in clash.collect()} == {0}


# --- chat


def test_template_language():
    assert chat.render("a{{ 'b' ~ 1 ~ (1 + 1) }}{# c #}") == ("ab12", [])
    assert chat.optimise(chat.parse("a{{ 'b' ~ 1 }}{% if 1 == 2 %}x{% else %}z{% endif %}")) == [("text", "ab1z")]
    out, spans = chat.render("{% for m in ms %}{{ loop.index }}{% if not loop.last %},{% endif %}{% generation %}{{ m.t | upper }}{% endgeneration %}{% endfor %}", ms=[{"t": "a"}, {"t": None}, {"t": "c"}])
    assert out == "1,A2,NONE3C" and [out[a:b] for a, b in spans] == ["A", "NONE", "C"]
    assert chat.render("{% set x = a['b'][0] %}{{ x }}{{ x.__class__ }}", a={"b": ["q"]})[0] == "q"
    assert chat.render("{{ 'a' in x and x or 'n' }}", x="xa")[0] == "xa"
    assert chat.render("a \n{%- if x -%}\n b {{- ' c}}d%} ' -}} e{# '}} #} f{%- endif %} g", x=1)[0] == "ab c}}d%} e f g"
    assert chat.parse("{{ 5 | length }}") and chat.fold(("filter", ("const", 5), "length")) == ("filter", ("const", 5), "length")
    with pytest.raises(TypeError):
        chat.render("{{ 5 | length }}")
    for bad in ("{% for %}", "{{ a b }}", "{% if x %}", "{{ open('x') }}", "{{ x | nofilter }}", "{% import os %}", "{{ x", "{% endfor %}"):
        with pytest.raises(chat.TemplateError):
            chat.render(bad, x="")


def test_guard_is_reversible():
    rng = random.Random(7)
    for _ in range(2000):
        t = "".join(rng.choice("\\<|n\nx>im_end") for _ in range(rng.randint(0, 20)))
        for f in (chat.guard, chat.guard_line):
            assert chat.unguard(f(t)) == t and "<|" not in f(t)
        assert "\n" not in chat.guard_line(t)


def test_conversations(spark):
    rng = random.Random(8)
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    for c in range(30):
        rows += [(c, t, rng.choice(["user", "assistant", "sys\ntem", None]), rng.choice([None, "", "a\\n<|b|>", "é😀 " * rng.randint(1, 50), said])) for t in range(rng.randint(1, 6))]
    rows += [(99, 1, "assistant", "same"), (99, 1, "assistant", "same"), (None, 0, "user", "x")]
    d = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("part", F.lit(0)).repartition(3)
    for part in (chat.PART, 40):
        got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(d, part=part)).collect()}
        assert set(got) == {r[0] for r in rows}
        for c, r in got.items():
            own = sorted((t, role or "", x or "") for k, t, role, x in rows if k == c)
            loss = "".join(x for _, role, x in own if role == "assistant")
            assert r["n_turns"] == len(own) and r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
            assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in own).encode()).hexdigest()
    assert chat.read_back(chat.format_conversations(d.limit(0))).count() == 0


# --- audio


def test_wav_and_resampling():
    for n in (0, 1, 64, 1001):
        data = bytes(i % 256 for i in range(n))
        assert audio.read_wav(audio.write_wav(data)) == (audio.RATE, data)
    for bad in (b"", b"RIFFxxxxWAVE", b"x" * 100):
        with pytest.raises(ValueError):
            audio.read_wav(bad)
    x = np.random.default_rng(1).standard_normal(1000).astype(np.float32)
    for up, down in ((1, 2), (2, 3), (3, 1), (1, 1)):
        half = audio._TAPS * max(up, down)
        n = np.arange(-half, half + 1)
        h = np.sinc(n / max(up, down)) * (0.5 + 0.5 * np.cos(np.pi * n / (half + 1)))
        z = np.zeros(len(x) * up)
        z[::up] = x
        want = np.convolve(z, h * up / h.sum())[half : half + len(z)][::down]
        got = audio.resample(x, up, down, audio.polyphase(up, down))
        assert np.abs(got - want[: len(got)]).max() < 1e-5


def test_hysteresis():
    e = np.array([0, 0, 5, 3, 3, 1, 3, 6, 3, 0, 0, 9], float)
    mean, high = e.mean(), e.mean() + 0.5 * e.std()
    want, on, begin = [], False, 0
    for i, x in enumerate(e):
        if not on and x >= high:
            on, begin = True, i
        elif on and x < mean:
            on = False
            want.append((begin, i))
    if on:
        want.append((begin, len(e)))
    assert audio.segments(e) == want


def test_features(spark):
    t = "".join(chr(32 + i % 90) for i in range(9000)) + "é" * 500
    d = spark.createDataFrame([(1, t), (2, t), (3, None), (4, ""), (5, "x" * 64), (6, "y" * 65)], "doc_id bigint, text string").withColumn("segments", F.lit(0))
    got = {r["doc_id"]: r for r in audio.features(d, ["doc_id"]).collect()}
    assert got[1]["feature"] == got[2]["feature"] and got[3]["feature"] == got[4]["feature"]
    assert [got[i]["payload_bytes"] for i in (3, 4, 5, 6)] == [64, 64, 64, 128]
    n, payload = audio.text_payload(t)
    assert got[1]["payload_sha256"] == hashlib.sha256(payload).hexdigest() and got[1]["tail_crc32"] == zlib.crc32(payload[-64:]) and got[1]["n_bytes"] == n
    assert got[1]["media_sha256"] == hashlib.sha256(bytes(got[1]["media"])).hexdigest()
    assert all(r["feature"] == audio.clip_summary(bytes(r["media"])) for r in got.values())  # what was stored and read back is what was computed
    tensors = audio.tensor_array([s["tensor"] for s in got[1]["segments"]])
    assert tensors.type.shape == [audio.POOL, audio.MELS] and len(tensors) == len(got[1]["segments"])
    assert all(s["start_ms"] < s["end_ms"] for s in got[1]["segments"])
    assert audio.features(d.limit(0), ["doc_id"]).count() == 0


def test_tensors_are_stored_as_arrow_tensors(spark):
    d = spark.createDataFrame([(i, "".join(chr(40 + (i * j * j) % 80) for j in range(900 * i))) for i in range(6)], "doc_id bigint, text string")
    media = audio.store_media(d.select(F.struct("doc_id").alias("kept"), "text"), "text")
    rows = audio.store_tensors(media, False).collect()
    segments = [audio.unpacked(bytes(r["segments"])) for r in rows]
    assert all(s.column("tensor").type == pa.fixed_shape_tensor(pa.float16(), [audio.POOL, audio.MELS]) for s in segments)
    assert sum(s.num_rows for s in segments) == sum(sum(audio.unpacked(bytes(r["clips"])).column("segments").to_pylist()) for r in rows) >= 6
    assert sorted(k["doc_id"] for r in rows for k in r["kept"]) == list(range(6))
    clash = audio.features(d.withColumn("feature", F.lit("mine")), ["doc_id", "feature"], with_media=False)
    assert clash.columns[:2] == ["doc_id", "feature"] and clash.columns[-1] == "feature_" and {r["feature"] for r in clash.collect()} == {"mine"}


def test_log_mel_and_pooling_by_definition():
    """Frames, Fourier sums, triangles in mels and means of parts, written out as sums."""
    rng = np.random.default_rng(3)
    y = rng.standard_normal(audio.FRAME + 7 * audio.HOP - 30).astype(np.float32)
    mels, energy = audio.log_mel(y)
    padded, bins = np.concatenate((y, np.zeros(30))), audio.FFT // 2 + 1
    assert len(mels) == len(energy) == 8
    to_mel = lambda f: 2595 * math.log10(1 + f / 700)
    low, high = to_mel(20.0), to_mel(audio.TARGET / 2)
    edge = [700 * (10 ** ((low + (high - low) * i / (audio.MELS + 1)) / 2595) - 1) for i in range(audio.MELS + 2)]
    for k in range(8):
        x = padded[k * audio.HOP : k * audio.HOP + audio.FRAME]
        assert abs(energy[k] - 10 * math.log10(sum(v * v for v in x) / audio.FRAME + 1e-10)) < 1e-3
        w = [x[n] * (0.5 - 0.5 * math.cos(2 * math.pi * n / audio.FRAME)) for n in range(audio.FRAME)]
        power = [abs(sum(w[n] * complex(math.cos(2 * math.pi * f * n / audio.FFT), -math.sin(2 * math.pi * f * n / audio.FFT)) for n in range(audio.FRAME))) ** 2 for f in range(bins)]
        for m in range(audio.MELS):
            total = 0.0
            for f in range(bins):
                hz = f * audio.TARGET / audio.FFT
                total += power[f] * max(0.0, min((hz - edge[m]) / (edge[m + 1] - edge[m]), (edge[m + 2] - hz) / (edge[m + 2] - edge[m + 1])))
            assert abs(mels[k, m] - math.log10(total + 1e-10)) < 1e-3
    media = audio.write_wav(bytes(rng.integers(0, 256, 6400).astype(np.uint8)))
    f = audio.clip_features(media)
    x = (np.frombuffer(audio.read_wav(media)[1], np.uint8).astype(np.float32) - 128) / 128
    mels, energy = audio.log_mel(audio.resample(x, 1, 2, audio.polyphase(1, 2)))
    assert np.allclose(f["mean"], mels.mean(axis=0), atol=1e-3) and f["frames"] == len(mels)
    for s, (a, b) in zip(f["segments"], audio.segments(energy)):
        assert s["start_ms"] == a * 10 and s["end_ms"] == (b - 1) * 10 + 25
        for p in range(audio.POOL):
            lo, hi = a + (b - a) * p // audio.POOL, a + (b - a) * (p + 1) // audio.POOL
            own = mels[lo : max(hi, lo + 1)].mean(axis=0)
            assert np.allclose(s["tensor"].reshape(audio.POOL, audio.MELS)[p], own, atol=1e-3)


# --- mixing


def test_exponents():
    tokens = [900.0, 90.0, 10.0]
    a = mixing.bisect_exponent(tokens, 4.0)
    w = mixing.weights(tokens, a)
    spread = [x / t for x, t in zip(w, tokens)]
    assert abs(max(spread) / min(spread) - 4.0) < 1e-6
    a = mixing.bisect_exponent(tokens, min_entropy=0.9)
    w = mixing.weights(tokens, a)
    assert abs(-sum(x * math.log(x) for x in w) / math.log(3) - 0.9) < 1e-6
    assert mixing.bisect_exponent([5.0], 2.0) == 1.0 and mixing.bisect_exponent([1.0, 1.0], 2.0) == 0.0


def test_mixture(spark):
    rng = random.Random(9)
    rows = [(i, "hot" if i % 3 else f"s{i % 4}", "w " * rng.randint(1, 40)) for i in range(4000)] + [(9001, None, None), (9002, None, "a b"), (9003, "none", None), (7, "hot", "again"), (7, "hot", "again")]
    d = spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("block", F.lit(1))
    got = mixing.mix(d).collect()
    taken, tokens = Counter(), Counter()
    for r in got:
        taken[r["doc_id"], r["pass"]] += 1
        tokens[r["source"]] += len((r["text"] or "").split())
        assert 0 <= r["mix_at"] <= 1
    assert {i for i, *_ in rows} == {i for i, _ in taken}  # nothing is dropped
    total = Counter()
    for _, s, t in rows:
        total[s] += len((t or "").split())
    repeat = {s: tokens[s] / total[s] for s in total if total[s]}
    assert abs(repeat["hot"] - 1) < 0.01 and max(repeat.values()) <= 2.1 and min(repeat[s] for s in ("s0", "s3")) > 1.1
    few = mixing.mix(d, budget=sum(total.values()) / 4.0).collect()
    assert abs(sum(len((r["text"] or "").split()) for r in few) / (sum(total.values()) / 4) - 1) < 0.1
    assert mixing.mix(d.limit(0)).count() == 0
    named = mixing.mix(d.withColumn("pass", F.lit("p")).withColumn("mix_at", F.lit("m")).withColumn("s", F.lit(1)).withColumn("row", F.lit(2)))
    assert named.columns[-2:] == ["pass_", "mix_at_"] and {(r["pass"], r["mix_at"], r["s"], r["row"]) for r in named.collect()} == {("p", "m", 1, 2)}


def test_mixture_against_lists(spark, monkeypatch):
    """Which documents are taken, how often and in which order, by sorting each source's blocks."""
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 5)
    rng = random.Random(19)
    rows = [(i, rng.choice(["big"] * 8 + ["small", "tiny", None]), " ".join("w" * rng.randint(0, 30))) for i in range(900)] + [(None, "big", f"x {i}") for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    tokens = {}
    for _, s, t in rows:
        tokens[s] = tokens.get(s, 0) + len(t.split())
    names = sorted(tokens, key=lambda s: "n" if s is None else f"s{s}")
    share = mixing.weights([float(tokens[s]) for s in names], mixing.bisect_exponent([float(tokens[s]) for s in names], 3.0))
    budget = max(tokens[s] / w for s, w in zip(names, share))
    want, n_blocks = {}, {s: -(-sum(r[1] == s for r in rows) // 5) for s in names}
    hashed = d.select("doc_id", "source", "text", F.xxhash64("doc_id", "text", F.lit(mixing.SEED)).alias("h")).collect()
    order = spark.createDataFrame([("n" if s is None else f"s{s}", b, t) for s in names for b in range(n_blocks[s]) for t in range(9)], "s string, b bigint, t int")
    place = {(r["s"], r["b"], r["t"]): r["at"] for r in order.select("s", "b", "t", mixing._order(F.col("s"), F.col("b"), F.col("t")).alias("at")).collect()}
    for s, w in zip(names, share):
        blocks = {}
        for r in hashed:
            if r["source"] == s:
                blocks.setdefault(r["h"] % n_blocks[s], []).append((r["doc_id"], r["text"]))
        left, turn = w * budget, 0
        while left > 1e-6:
            for b in sorted(blocks, key=lambda b: place["n" if s is None else f"s{s}", b, turn]):
                own = sum(len(t.split()) for _, t in blocks[b])
                if left < own / 2 or left <= 1e-6 and own:
                    left = 0
                    break
                left -= own
                for doc in blocks[b]:
                    want.setdefault((s, turn), []).append(doc)
            turn += 1
    got = {}
    for r in sorted(mixing.mix(d, max_repeat=3.0).collect(), key=lambda r: r["mix_at"]):
        got.setdefault((r["source"], r["pass"]), []).append((r["doc_id"], r["text"]))
    assert {k: Counter(v) for k, v in got.items()} == {k: Counter(v) for k, v in want.items()}
    for k, docs in got.items():  # blocks follow each other in the order of the permutation; cells of equal sums may tie
        spot = {doc: i for i, doc in enumerate(want[k])}
        assert np.mean([abs(spot[doc] - i) < 12 for i, doc in enumerate(docs)]) > 0.95


def test_last_samples_are_in_a_frame():
    rng = np.random.default_rng(6)
    for n in (704, 1024, 64 * 37):
        payload = rng.integers(0, 256, n).astype(np.uint8)
        changed = payload.copy()
        changed[-40:] = 255 - changed[-40:]
        one, two = (audio.clip_summary(audio.write_wav(x.tobytes())) for x in (payload, changed))
        assert one != two
